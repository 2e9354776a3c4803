"""Feeds (A3, A4): RSS, RDF and Atom bodies to entries. Feeds are spread over the cluster, one row each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_null

MOST = 25
ENTRY = "feed_url string, ord int, external_id string, title string, enclosure_url string, published string, updated string, feed_title string, image_url string, error string"


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""


def _text(e: ElementTree.Element, *names: str) -> str | None:
    """Collapsed text of the first child, by the order of the names, that has any."""
    for name in names:
        for child in e:
            if _name(child) == name and (text := " ".join("".join(child.itertext()).split())):
                return text
    return None


def _media(entry: ElementTree.Element) -> str | None:
    """Enclosure, then a link marked so, then a content's address, then the first link."""
    children = list(entry)
    choices = (
        [c.get("url") for c in children if _name(c) == "enclosure"],
        [c.get("href") for c in children if _name(c) == "link" and c.get("rel") == "enclosure"],
        [c.get("url") or c.get("src") for c in entry.iter() if _name(c) == "content"],
        [c.get("href") or (c.text or "").strip() for c in children if _name(c) == "link"],
    )
    return next((u for urls in choices for u in urls if u), None)


def entries(url: str, body: bytes) -> list[tuple]:
    root = ElementTree.fromstring(body)
    if _name(root) not in ("rss", "rdf", "feed"):
        raise ValueError("not a feed")
    head = next((e for e in root.iter() if _name(e) == "channel"), root)
    image = next((e.get("href") or _text(e, "url") for e in head.iter() if _name(e) in ("image", "logo", "icon") and (e.get("href") or _text(e, "url"))), None) or _text(head, "logo", "icon")
    out = []
    for k, e in enumerate(x for x in root.iter() if _name(x) in ("item", "entry")):
        media = _media(e)
        ident = _text(e, "guid", "id") or (hashlib.sha256(media.encode()).hexdigest()[:16] if media else None)
        out.append((url, k, ident, _text(e, "title"), media, _text(e, "pubdate", "published", "date"), _text(e, "updated", "modified"), _text(head, "title"), image, None))
    return out or [(url, None, None, None, None, None, None, _text(head, "title"), image, None)]


def parse_feeds(feeds: DataFrame, max_episodes: int | None = MOST) -> DataFrame:
    """A3: feeds (feed_url, body as bytes or text) to entries in document order; a body that is no feed is one row with an error.

    A feed without entries is one row without ord.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for pdf in parts:
            rows: list[tuple] = []
            for url, body in zip(pdf["feed_url"], pdf["body"], strict=True):
                try:
                    rows += entries(url, bytes(body or b""))
                except (ElementTree.ParseError, ValueError, LookupError) as e:
                    rows.append((url, *[None] * 8, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names).astype({"ord": "Int32"})

    out = feeds.select("feed_url", F.col("body").cast("binary").alias("body")).mapInPandas(run, ENTRY)
    return out if max_episodes is None else out.where(F.col("ord").isNull() | (F.col("ord") < max_episodes))


def feed_summary(parsed: DataFrame) -> DataFrame:
    """A4: (feed_url, title, image_url, episode_count) of parsed feeds (all their entries)."""
    return parsed.where("error is null").groupBy("feed_url").agg(F.coalesce(or_null(F.first("feed_title", ignorenulls=True)), F.lit("Podcast feed")).alias("title"), F.first("image_url", ignorenulls=True).alias("image_url"), F.count("ord").alias("episode_count"))
