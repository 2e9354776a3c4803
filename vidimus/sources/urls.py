"""Source addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_null


def _internal(host: Column) -> Column:
    """Local names, and addresses that are loopback, private, link-local, shared, unspecified or broadcast."""
    h = F.lower(F.regexp_replace(host, r"\.+$", ""))
    name = (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | (h == "metadata.google.internal")
    four = h.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|\d{1,2})(\.(25[0-5]|2[0-4]\d|1\d\d|\d{1,2})){3}$")
    octet = lambda k: F.element_at(F.split(h, r"\."), k).try_cast("int")
    a, b = octet(1), octet(2)
    private = (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | h.isin("0.0.0.0", "255.255.255.255")
    six = h.rlike(r"^\[(::1|::|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*)\]$")
    return name | F.coalesce(F.when(four, private), F.lit(False)) | six


def classify_source_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """A5: urls with platform, kind (single or author), canonical_url and reject_reason; exactly one of platform and reason is set."""
    u = F.trim(F.col(url))
    part = lambda name, *key: F.try_parse_url(u, F.lit(name), *map(F.lit, key))
    rows = urls.withColumns({"u_": u, "scheme_": F.lower(part("PROTOCOL")), "host_": F.lower(part("HOST")), "user_": part("USERINFO"), "path_": F.coalesce(part("PATH"), F.lit("")), "query_": F.coalesce(part("QUERY"), F.lit(""))})
    host = F.regexp_replace("host_", r"^(www\.)+", "")
    parts = F.filter(F.split("path_", "/"), lambda p: p != "")
    first, second = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), F.try_element_at(parts, F.lit(2))
    has = lambda key: F.col("query_").rlike(rf"(^|&){key}(=|&|$)")
    value = lambda key: F.nullif(F.regexp_extract("query_", rf"(?:^|&){key}=([^&]*)", 1), F.lit(""))
    youtube, bilibili = (host == "youtube.com") | host.endswith(".youtube.com"), (host == "bilibili.com") | host.endswith(".bilibili.com")
    author_path = F.when(F.try_element_at(parts, F.lit(-1)) == "videos", parts).otherwise(F.array_append(parts, F.lit("videos")))
    author_url = F.concat("scheme_", F.lit("://"), "host_", F.lit("/"), F.array_join(author_path, "/"))
    page = F.when(value("p").rlike(r"^\+?0*[1-9]\d{0,8}$"), value("p").try_cast("long"))
    video_url = F.concat(F.lit("https://www.bilibili.com/video/"), second, F.coalesce(F.concat(F.lit("?p="), page.cast("string")), F.lit("")))
    ok = lambda platform, kind, to: F.struct(F.lit(platform).alias("platform"), F.lit(kind).alias("kind"), to.alias("canonical_url"), F.lit(None).cast("string").alias("reject_reason"))
    no = lambda why: F.struct(F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("canonical_url"), F.lit(why).alias("reject_reason"))
    whole = F.col("u_")
    rule = (
        F.when(F.col("scheme_").isNull(), no("not a valid URL"))
        .when(~F.col("scheme_").isin("http", "https"), no("must be http or https"))
        .when(F.coalesce(F.col("user_"), F.lit("")) != "", no("must not include credentials"))
        .when(F.col("host_").isNull() | (F.col("host_") == ""), no("missing a host"))
        .when(_internal(F.col("host_")), no("must not target local or private network hosts"))
        .when((host == "youtu.be") & (F.size(parts) == 0), no("missing video id"))
        .when(host == "youtu.be", ok("youtube", "single", whole))
        .when(youtube & ((first == "playlist") | (has("list") & ~has("v"))), no("playlists are not supported"))
        .when(youtube & (((first == "watch") & value("v").isNotNull()) | (first.isin("shorts", "live") & (F.size(parts) >= 2))), ok("youtube", "single", whole))
        .when(youtube & (first.startswith("@") | first.isin("channel", "c", "user")), ok("youtube", "author", author_url))
        .when(youtube, no("unsupported YouTube URL"))
        .when(host == "b23.tv", ok("bilibili", "single", whole))
        .when(bilibili & (first == "video") & (F.size(parts) >= 2), ok("bilibili", "single", video_url))
        .when((host == "space.bilibili.com") & (F.size(parts) > 0), ok("bilibili", "author", F.concat(F.lit("https://space.bilibili.com/"), first, F.lit("/video"))))
        .when(bilibili, no("unsupported Bilibili URL"))
        .otherwise(no("unsupported video host"))
    )
    return rows.withColumn("r_", rule).select(*[c for c in urls.columns if c not in ("platform", "kind", "canonical_url", "reject_reason")], "r_.platform", "r_.kind", "r_.canonical_url", "r_.reject_reason")


# Where an item's address is looked for.
URL_KEYS = ("webpage_url", "original_url", "source_url", "url", "canonical_url", "episode_url", "enclosure_url")
CONFIG_KEYS = ("url", "feed_url", "channel_url")


def select_source_url(metadata: str = "metadata", config: str = "config") -> Column:
    """The first http(s) address of the metadata, else the platform's by its id, else one of the source's configuration."""
    web = lambda c, k: F.when(F.get_json_object(c, f"$.{k}").rlike(r"^https?://"), or_null(F.get_json_object(c, f"$.{k}")))
    ident = or_null(F.get_json_object(metadata, "$.platform_id"))
    platform = F.get_json_object(metadata, "$.platform")
    by_id = F.when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), ident)).when(platform == "bilibili", F.concat(F.lit("https://www.bilibili.com/video/"), ident))
    return F.coalesce(*[web(metadata, k) for k in URL_KEYS], by_id, *[web(config, k) for k in CONFIG_KEYS])
