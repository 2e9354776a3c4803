"""Evidence products from ranked hits (E), for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import clock, ellipsis, json_number, or_null, slug
from .lexical import hinted

SNIPPET, QUOTE = 360, 240
IMAGE_SECONDS, SHORTEST = 4.0, 0.25
NOT_BLANK = r"[^\s\p{Z}]"


def evidence_kind() -> Column:
    c = F.col("chunk_type")
    return F.when(c == "document", "document").when(c.isin("image", "keyframe", "ocr"), "frame").when(F.col("item_content_type").isin("video", "audio") & F.col("start_sec").isNotNull(), "video_clip").otherwise("chunk")


def enrich_hits(hits: DataFrame, sources: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Names with defaults, time label, snippet and quote, page and section, kind of evidence, deep link, and whether the file is there."""
    named = sources.select(F.col("id").alias("source_id"), F.coalesce(or_null(F.get_json_object("config", "$.title")), F.col("type")).alias("source_name"), F.col("type").alias("source_type"))
    out = hits.join(named, "source_id", "left").withColumn("item_title", F.coalesce(or_null("item_title"), F.lit("Untitled"))).withColumn("source_name", F.coalesce("source_name", F.lit("Unknown source")))
    if listing is not None:
        there = listing.select(F.col("path").alias("raw_path"), F.lit(True).alias("file_exists")).distinct()
        out = out.join(there, "raw_path", "left").withColumn("file_exists", F.coalesce("file_exists", F.lit(False)))
    else:
        out = out.withColumn("file_exists", F.col("raw_path").isNotNull())
    label = F.when(F.col("start_sec").isNull(), None).when(F.col("end_sec").isNull(), clock("start_sec")).otherwise(F.concat(clock("start_sec"), F.lit("-"), clock("end_sec")))
    page, section = json_number("unit_metadata", "page").cast("long"), or_null(F.get_json_object("unit_metadata", "$.section"))
    link = F.concat(F.lit("item/"), "item_id", F.when(F.col("start_sec").isNotNull(), F.concat(F.lit("?t="), F.floor("start_sec").cast("string"))).otherwise(F.lit("")))
    return out.withColumns({"time_label": label, "quote": ellipsis("snippet", QUOTE), "snippet": ellipsis("snippet", SNIPPET), "page": page, "section": section, "evidence_kind": evidence_kind(), "deep_link": link})


def extractive_answer(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer, citations): the first three quotes as sentences; queries without evidence say so. hits are enriched.

    Which hits are cited is told by narrow rows first; only their sentences are made and sorted.
    """
    blank = ~F.coalesce(F.col("quote").rlike(NOT_BLANK), F.lit(False))
    first = hits.where(~blank).select(F.col("query_id").alias("query_"), F.col("rank").alias("rank_"), F.col("unit_id").alias("unit_"))
    first = stored(first.withColumn("n_", F.row_number().over(Window.partitionBy("query_").orderBy("rank_", "unit_"))).where("n_ <= 3").drop("n_"))
    place = F.when(F.col("evidence_kind") == "document", F.concat_ws(", ", F.when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page").cast("string"))), "section")).otherwise(F.col("time_label"))
    same = (F.col("query_id") == F.col("query_")) & F.col("rank").eqNullSafe(F.col("rank_")) & F.col("unit_id").eqNullSafe(F.col("unit_"))
    cited = hits.join(hinted(first), same, "left_semi").select("query_id", F.struct(blank.alias("blank"), "rank", "unit_id", F.concat(F.col("item_title"), F.when(or_null(place).isNotNull(), F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(F.lit("")), F.lit(": "), F.col("quote")).alias("sentence")).alias("c"))
    cited = cited.withColumn("n_", F.row_number().over(Window.partitionBy("query_id").orderBy("c"))).where("n_ <= 3 AND NOT c.blank").groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    zh = F.coalesce(F.lower("locale").startswith("zh"), F.lit(False))
    none = F.when(zh, "没有找到相关证据。").otherwise("No evidence was found for this query.")
    intro = F.when(zh, "根据资料：").otherwise("From your library: ")
    out = queries.select("query_id", "locale").join(cited, "query_id", "left")
    text = F.concat(intro, F.array_join(F.transform("cs", lambda c: c["sentence"]), " "))
    return out.select("query_id", F.when(F.col("cs").isNull(), none).otherwise(text).alias("answer"), F.coalesce(F.transform("cs", lambda c: c["unit_id"]), F.array().cast("array<string>")).alias("citations"))


MODALITIES = ("video", "audio", "image", "document")


def material_summary(hits: DataFrame) -> DataFrame:
    """(query_id, n_results, n_items, modalities in a fixed order). hits have modality."""
    held = F.collect_set("modality")
    return hits.groupBy("query_id").agg(F.count("*").alias("n_results"), F.count_distinct("item_id").alias("n_items"), F.filter(F.array(*map(F.lit, MODALITIES)), lambda m: F.array_contains(held, m)).alias("modalities"))


def material_topics(hits: DataFrame) -> DataFrame:
    """(query_id, modality, n_items, evidence)."""
    return hits.groupBy("query_id", "modality").agg(F.count_distinct("item_id").alias("n_items"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))), lambda s: s["unit_id"]).alias("evidence"))


def usable_shots(hits: DataFrame) -> DataFrame:
    """Hits of media with a finite time, a clip or a preview. hits have modality, clip_path and preview_path."""
    finite = F.col("start_sec").isNotNull() & ~F.isnan("start_sec")
    return hits.where((F.col("modality") != "document") & (finite | F.col("clip_path").isNotNull() | F.col("preview_path").isNotNull()))


def shot_list(hits: DataFrame, name: str = "shot") -> DataFrame:
    """E5: shots in rank order with shot-01 or beat-01; needs a source file, and a range over a quarter second for video and audio."""
    ranged = F.coalesce(F.col("end_sec") - F.col("start_sec") > SHORTEST, F.lit(False))
    fit = hits.where(F.col("raw_path").isNotNull() & (F.col("modality") != "document") & (~F.col("modality").isin("video", "audio") | ranged))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return fit.withColumn("place", place).withColumn("shot_id", F.format_string(f"{name}-%02d", "place"))


def storyboard(hits: DataFrame) -> DataFrame:
    return shot_list(hits, "beat")


def broll_candidates(shots: DataFrame) -> DataFrame:
    """Video and image shots with a clip or a preview."""
    return shots.where(F.col("modality").isin("video", "image") & (F.col("clip_path").isNotNull() | F.col("preview_path").isNotNull()))


def broll_gaps(shots: DataFrame) -> DataFrame:
    """(query_id, shot_id, candidates): audio shots and up to three other shots that could cover them."""
    options = broll_candidates(shots).withColumn("n_", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where("n_ <= 4")
    options = options.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "shot_id"))), lambda s: s["shot_id"]).alias("options"))
    gaps = shots.where(F.col("modality") == "audio").join(options, "query_id", "left")
    return gaps.select("query_id", "shot_id", F.coalesce(F.slice(F.filter("options", lambda s: s != F.col("shot_id")), 1, 3), F.array().cast("array<string>")).alias("candidates"))


def timeline_clips(shots: DataFrame) -> DataFrame:
    """E7's rows: (query_id, track, place, name, source_ms, duration_ms, offset_ms); images take 4 s; offsets run within a track."""
    seconds = F.when(F.col("modality") == "image", IMAGE_SECONDS).otherwise(F.col("end_sec") - F.col("start_sec"))
    clips = shots.select("query_id", F.when(F.col("modality") == "audio", "Audio").otherwise("Video").alias("track"), "place", F.col("item_title").alias("name"), "raw_path", F.round(F.coalesce("start_sec", F.lit(0.0)) * 1000).cast("long").alias("source_ms"), F.round(seconds * 1000).cast("long").alias("duration_ms"))
    before = F.sum("duration_ms").over(Window.partitionBy("query_id", "track").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return clips.withColumn("offset_ms", F.coalesce(before, F.lit(0)))


def timeline_export(shots: DataFrame) -> DataFrame:
    """(query_id, timeline): JSON with the Video and then the Audio track, times as rational milliseconds."""
    time = lambda c: F.struct(F.col(c).alias("value"), F.lit(1000).alias("rate"))
    clip = F.struct("place", "name", F.col("raw_path").alias("media"), time("source_ms").alias("source_start"), time("duration_ms").alias("duration"), time("offset_ms").alias("offset"))
    tracks = timeline_clips(shots).groupBy("query_id", "track").agg(F.array_sort(F.collect_list(F.struct("place", clip.alias("clip")))).alias("cs"))
    tracks = tracks.select("query_id", F.struct(F.when(F.col("track") == "Video", 0).otherwise(1).alias("order"), F.col("track").alias("name"), F.transform("cs", lambda c: c["clip"]).alias("clips")).alias("t"))
    return tracks.groupBy("query_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["name"].alias("name"), t["clips"].alias("clips"))).alias("tracks"))).alias("timeline"))


def clip_windows(hits: DataFrame, before: float = 2.0, after: float = 2.0) -> DataFrame:
    """clip_start and clip_seconds: up to 30 s around, 12 s where there is no end, 1 to 120 s long."""
    low = F.greatest(F.col("start_sec") - min(before, 30.0), F.lit(0.0))
    high = F.coalesce("end_sec", F.col("start_sec") + 12.0) + min(after, 30.0)
    return hits.withColumn("clip_start", low).withColumn("clip_seconds", F.least(F.greatest(high - low, F.lit(1.0)), F.lit(120.0)))


def clip_name() -> Column:
    return F.concat_ws("-", slug("item_title"), F.floor("start_sec").cast("string"))
