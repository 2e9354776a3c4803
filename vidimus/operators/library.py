"""Library tables (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, or_null
from .units import nearest_frame_asof
from .usage import usage_by

CHUNK_ALIASES = {"transcript": ("transcript", "transcript_line", "audio"), "visual": ("keyframe", "image", "ocr"), "summary": ("understanding",)}
LIMITS = {"small": (50, 100), "medium": (100, 250), "large": (250, 1000)}


def list_items(items: DataFrame, chunks: DataFrame, usage: DataFrame | None = None, status: str | None = None, source: str | None = None, source_type: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """items that aren't being deleted, with duration (else the latest end of a chunk), thumbnail, chunk count and cost."""
    frame = F.when(F.col("frame_path").isNotNull(), F.struct(F.coalesce("start_sec", F.lit(0.0)).alias("s"), F.col("id").alias("i")))
    own = chunks.groupBy("item_id").agg(F.max(F.coalesce("end_sec", "start_sec")).alias("last_"), F.count("*").alias("chunk_count"), F.min_by("frame_path", frame).alias("thumbnail"))
    out = items.where(F.coalesce(F.col("status") != "deleting", F.lit(True)))
    out = out if status is None else out.where(F.col("status") == status)
    out = out if source is None else out.where(F.col("source_id") == source)
    if source_type is not None and sources is not None:
        out = out.join(sources.where(F.col("type") == source_type).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    out = out.join(own.withColumnRenamed("item_id", "id"), "id", "left").withColumn("duration_sec", F.coalesce("duration_sec", "last_")).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).drop("last_")
    if usage is not None:
        out = out.join(usage_by(usage, "item_id").select(F.col("item_id").alias("id"), "estimated_usd", "events"), "id", "left")
    return out.orderBy(F.desc("indexed_at"), "id")


def list_chunks(chunks: DataFrame, item: str | None = None, kind: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """by kind (also transcript, visual and summary as groups) and by a range of time."""
    out = chunks if item is None else chunks.where(F.col("item_id") == item)
    out = out if kind is None else out.where(F.col("chunk_type").isin(*CHUNK_ALIASES.get(kind, (kind,))))
    out = out if end is None else out.where(F.coalesce(F.col("start_sec") <= end, F.lit(True)))
    out = out if start is None else out.where(F.coalesce(F.coalesce("end_sec", "start_sec") >= start, F.lit(True)))
    return out.orderBy(F.coalesce("start_sec", F.lit(0.0)), "id")


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, size: str = "small", after: Column | None = None) -> tuple[DataFrame, Column]:
    """(rows with one more than the limit, next cursor); after is a keyset condition for deep pages, instead of the offset."""
    default, most = LIMITS[size]
    n = min(max(1, limit or default), most)
    rows = (df if after is None else df.where(after)).orderBy(*order)
    return (rows.offset(offset) if offset else rows).limit(n + 1), F.lit(offset + n)


def sort_library(items: DataFrame, by: str = "recent") -> DataFrame:
    """F4."""
    return items.orderBy({"recent": F.desc("indexed_at"), "longest": F.desc_nulls_last("duration_sec"), "shortest": F.asc_nulls_last("duration_sec"), "title": F.lower("title").asc()}[by], "id")


def duration_bucket(c: str = "duration_sec") -> Column:
    m = F.col(c) / 60
    return F.when(m.isNull(), None).when(m < 5, "under_5").when(m < 20, "5_to_20").when(m < 60, "20_to_60").otherwise("over_60")


def age_bucket(now: int, c: str = "indexed_at") -> Column:
    days = (F.lit(now) - F.col(c)) / 86_400
    return F.when(days.isNull(), None).when(days <= 7, "week").when(days <= 30, "month").otherwise("older")


def library_facets(items: DataFrame, now: int) -> DataFrame:
    """(facet, value, n) for status, kind, source, duration and age, in one pass over the items."""
    facets = {"status": F.col("status"), "content_type": F.col("content_type"), "source": F.col("source_id"), "duration": duration_bucket(), "age": age_bucket(now)}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in facets.items()]))
    return items.select(pairs.alias("p")).select("p.facet", "p.value").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def filter_library(items: DataFrame, now: int, text: str | None = None, **facets: str) -> DataFrame:
    """F5's filters; text is part of the title."""
    columns = {"status": F.col("status"), "content_type": F.col("content_type"), "source": F.col("source_id"), "duration": duration_bucket(), "age": age_bucket(now)}
    out = items if text is None else items.where(F.lower("title").contains(text.lower()))
    for k, v in facets.items():
        out = out.where(columns[k] == v)
    return out


def derive_item_status(items: DataFrame) -> DataFrame:
    """shown_status, partial, speech_searchable and visual_searchable from the status and the artifacts in metadata."""
    at = lambda k: F.get_json_object("metadata", f"$.artifacts.{k}")
    kinds = ("transcript", "ocr", "understanding", "embedding")
    some = F.lit(False)
    for k in kinds:
        some = some | F.coalesce(at(k) == "indexed", F.lit(False))
    done = F.coalesce((F.col("status") == "indexed") | F.col("indexed_at").isNotNull() | some, F.lit(False))
    bad = F.lit(False)
    for k in kinds:
        bad = bad | F.coalesce(at(k) == "failed", F.lit(False))
    return items.withColumn("shown_status", F.when(done, "indexed").when(F.col("status") == "failed", "failed").otherwise("indexing")).withColumn("partial", done & bad).withColumn("speech_searchable", F.coalesce(at("transcript") == "indexed", F.lit(False))).withColumn("visual_searchable", F.coalesce((at("ocr") == "indexed") | (at("understanding") == "indexed"), F.lit(False)))


def source_kind(c: str = "type") -> Column:
    """the category of a source's type."""
    t = F.lower(F.col(c))
    return F.when(t.rlike("youtube|bilibili|web_video"), "web").when(t.rlike("rss|podcast"), "podcast").when(t.rlike("^folder"), "folder").when(t.rlike("^file|upload"), "file").otherwise("other")


def recently_indexed(items: DataFrame, n: int = 4) -> DataFrame:
    """F8."""
    return items.where("status = 'indexed'").orderBy(F.desc("indexed_at"), "id").limit(n)


def continue_watching(items: DataFrame, positions: DataFrame, n: int = 1) -> DataFrame:
    """F8: the latest position of an item that is no image."""
    return positions.join(items.where("content_type <> 'image'").select(F.col("id").alias("item_id"), "title", "duration_sec"), "item_id").orderBy(F.desc("updated_at"), "item_id").limit(n)


def total_runtime(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("seconds"))


def source_rollup(sources: DataFrame, items: DataFrame) -> DataFrame:
    """items and failed items of each source, newest first, with a short label that is told apart by number where labels meet."""
    counts = items.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_items"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    path = F.coalesce(F.get_json_object("config", "$.path"), F.get_json_object("config", "$.url"), F.get_json_object("config", "$.feed_url"), F.col("type"))
    label = F.coalesce(or_null(F.get_json_object("config", "$.title")), F.element_at(F.filter(F.split(F.regexp_replace(path, r"^https?://", ""), "/"), lambda p: p != ""), -1))
    out = sources.join(counts, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).withColumn("n_failed", F.coalesce("n_failed", F.lit(0))).withColumn("label", label)
    again = F.row_number().over(Window.partitionBy("label").orderBy("created_at", "id"))
    return out.withColumn("again_", again).withColumn("label", F.when(F.col("again_") > 1, F.concat("label", F.lit(" ("), F.col("again_").cast("string"), F.lit(")"))).otherwise(F.col("label"))).drop("again_").orderBy(F.desc("created_at"), "id")


def list_moments(moments: DataFrame, items: DataFrame) -> DataFrame:
    """newest first; a moment without a title has its item's."""
    named = items.select(F.col("id").alias("item_id"), F.col("title").alias("item_title"))
    return moments.join(named, "item_id", "left").withColumn("title", F.coalesce(or_null("title"), or_null("item_title"), F.lit("Untitled"))).orderBy(F.desc("created_at"), "id")


def validate_moments(moments: DataFrame, items: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): a quote, an item that exists, and a chunk of that item where one is named."""
    of_item = items.select(F.col("id").alias("item_id"), F.lit(True).alias("item_"))
    of_chunk = chunks.select("item_id", F.col("id").alias("chunk_id"), F.lit(True).alias("chunk_"))
    checked = moments.join(of_item, "item_id", "left").join(of_chunk, ["item_id", "chunk_id"], "left")
    good = or_null("quote").isNotNull() & F.col("item_").isNotNull() & (F.col("chunk_id").isNull() | F.col("chunk_").isNotNull())
    return checked.where(good).select(moments.columns), checked.where(~good).select(moments.columns)


def export_moments(moments: DataFrame, form: str = "markdown") -> DataFrame:
    """(id, text) as Markdown or as a citation."""
    time = F.when(F.col("start_sec").isNotNull(), F.concat(F.lit(" ("), clock("start_sec"), F.lit(")"))).otherwise(F.lit(""))
    note = F.when(or_null("note").isNotNull(), F.concat(F.lit("\n\n"), F.col("note"))).otherwise(F.lit(""))
    text = F.concat(F.lit("## "), "title", time, F.lit("\n\n> "), "quote", note) if form == "markdown" else F.concat(F.lit("“"), "quote", F.lit("” — "), "title", time)
    return moments.select("id", text.alias("text"))


def playback_positions(updates: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, position_sec, updated_at, near_end): the latest valid position of each item."""
    good = updates.where((F.col("position_sec") >= 0) & ~F.isnan("position_sec"))
    last = good.groupBy("item_id").agg(F.max_by("position_sec", F.struct("updated_at", "position_sec")).alias("position_sec"), F.max("updated_at").alias("updated_at"))
    out = last.join(items.select(F.col("id").alias("item_id"), "duration_sec"), "item_id")
    near = (F.col("duration_sec") - F.col("position_sec") <= 8) | (F.col("position_sec") >= 0.98 * F.col("duration_sec"))
    return out.withColumn("near_end", F.coalesce(near & (F.col("duration_sec") > 0), F.lit(False))).drop("duration_sec")


def nearest_chunk_for_time(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """targets (target_id, item_id, at, preferred_id, label) with chunk_id: the preferred row, else the one with the label's time, else the nearest.

    Two equi-joins and an as-of join; no target meets all rows of its item.
    """
    own = chunks.select("item_id", F.col("id").alias("chunk_id"), F.col("start_sec").alias("s_"))
    named = targets.join(own.select("item_id", F.col("chunk_id").alias("preferred_id")).distinct(), ["item_id", "preferred_id"], "left_semi").select("target_id", F.col("preferred_id").alias("named_"))
    timed = own.where("s_ is not null")
    labelled = targets.where("label is not null").join(timed.withColumn("label", clock("s_")), ["item_id", "label"]).groupBy("target_id").agg(F.min_by("chunk_id", F.struct(F.abs(F.col("s_") - F.col("at")).alias("d"), "s_", "chunk_id")).alias("labelled_"))
    near = nearest_frame_asof(targets.select("item_id", "target_id", "at"), timed.select("item_id", F.col("chunk_id").alias("id"), F.col("s_").alias("start_sec"), F.lit(None).cast("string").alias("frame_path"))).select("target_id", F.col("frame_id").alias("near_"))
    out = targets.join(named.distinct(), "target_id", "left").join(labelled, "target_id", "left").join(near.distinct(), "target_id", "left")
    return out.withColumn("chunk_id", F.coalesce("named_", "labelled_", "near_")).drop("named_", "labelled_", "near_")
