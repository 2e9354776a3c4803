"""Evidence chunks (B): from segments, frames and understandings to typed, time-stamped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_number, json_text, limited, or_null, stripped


def transcript_lines(segments: DataFrame) -> DataFrame:
    """B1: (item_id, ord, start_sec, end_sec, text); blank segments go, the order index counts the others."""
    kept = segments.withColumn("text", or_null("text")).where("text is not null")
    order = Window.partitionBy("item_id").orderBy("start_sec", "end_sec", "text")
    return kept.select("item_id", (F.row_number().over(order) - 1).alias("ord"), "start_sec", "end_sec", "text")


def transcript_windows(segments: DataFrame, window: float = 12.0, overlap: float = 2.0) -> DataFrame:
    """B2: (item_id, k, start_sec, end_sec, text) on a grid of step window - overlap from the first segment's start.

    Each segment is sent to the grid windows it overlaps by arithmetic; there is no self-join. An item with one segment
    passes through whole. Start and end are those of the overlapping segments, cut to the window.
    """
    if not 0 <= overlap < window:
        raise ValueError("0 <= overlap < window")
    step = window - overlap
    kept = segments.withColumn("text", or_null("text")).where("text is not null")
    grid = kept.groupBy("item_id").agg(F.min("start_sec").alias("first"), F.max("end_sec").alias("last"), F.count("*").alias("n"))
    rows = kept.join(grid, "item_id")
    low = F.greatest(F.lit(0), F.floor((F.col("start_sec") - F.col("first") - window) / step) + 1)
    high = F.least(F.ceil((F.col("end_sec") - F.col("first")) / step) - 1, F.ceil((F.col("last") - F.col("first")) / step) - 1)
    many = rows.where("n > 1").withColumn("k", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    begin = F.col("first") + F.col("k") * step
    many = many.where((F.col("end_sec") > begin) & (F.col("start_sec") < begin + window))
    merged = many.groupBy("item_id", "k", begin.alias("begin")).agg(
        F.min("start_sec").alias("s"), F.max("end_sec").alias("e"), F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "text"))).alias("parts")
    )
    merged = merged.select("item_id", "k", F.greatest("s", "begin").alias("start_sec"), F.least("e", F.col("begin") + window).alias("end_sec"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
    return merged.union(rows.where("n = 1").select("item_id", F.lit(0).cast("long"), "start_sec", "end_sec", "text"))


def keyframes(frames: DataFrame, interval: float = 10.0) -> DataFrame:
    """Times of frames from the number in frame_%06d, else from their place, every interval seconds."""
    number = F.regexp_extract("frame_path", r"frame_(\d{6})", 1).try_cast("long") - 1
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("frame_path")) - 1
    start = F.coalesce(number, place.cast("long")) * interval
    return frames.withColumn("start_sec", start).withColumn("end_sec", start + interval)


def drop_adjacent_duplicate_frames(frames: DataFrame) -> DataFrame:
    """Without frames (item_id, frame_no, content) whose bytes equal the frame's before them."""
    digest = F.sha2("content", 256)
    before = F.lag(digest).over(Window.partitionBy("item_id").orderBy("frame_no"))
    return frames.withColumn("before_", before).where(F.col("before_").isNull() | (F.col("before_") != digest)).drop("before_")


def ocr_rows(ocr: DataFrame) -> DataFrame:
    """One untimed row a frame; its time comes from the frame of the same path."""
    return ocr.where(or_null("text").isNotNull()).select("item_id", F.lit("ocr").alias("chunk_type"), F.lit(None).cast("double").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"), "text", "frame_path")


UNDERSTANDING = "summary string, chapters array<struct<title string, start_sec double, start double, end_sec double, end double, summary string>>, events array<struct<caption string, start_sec double, start double, end_sec double, end double>>"


def explode_understanding(understandings: DataFrame) -> DataFrame:
    """(item_id, kind, ord, start_sec, end_sec, text): the summary untimed, chapters with a title, events with a caption."""
    parsed = understandings.select("item_id", F.from_json("result", UNDERSTANDING).alias("r"), "summary")
    summary = parsed.select("item_id", F.lit("summary").alias("kind"), F.lit(0).alias("ord"), F.lit(None).cast("double").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"), F.coalesce(or_null("r.summary"), or_null("summary")).alias("text"))
    chapters = parsed.select("item_id", F.posexplode("r.chapters").alias("ord", "c")).select("item_id", F.lit("chapter"), "ord", F.coalesce("c.start_sec", "c.start"), F.coalesce("c.end_sec", "c.end"), F.when(or_null("c.title").isNotNull(), F.concat_ws(": ", or_null("c.title"), or_null("c.summary"))))
    events = parsed.select("item_id", F.posexplode("r.events").alias("ord", "c")).select("item_id", F.lit("event"), "ord", F.coalesce("c.start_sec", "c.start"), F.coalesce("c.end_sec", "c.end"), or_null("c.caption"))
    return summary.union(chapters).union(events).where("text is not null")


SEARCHED = "display_title string, searchable_text string, summary string, topics array<string>, chapters array<struct<title string, summary string>>, events array<struct<caption string, visual array<string>, audio array<string>, actions array<string>, entities array<string>>>"


def understanding_search_text(result: Column | str) -> Column:
    """The explicit searchable text if present, else summary, chapters, events and topics, a line each; the display title first.

    Of title, explicit text and summary equal ones stand once; the others are not compared.
    """
    r = F.from_json(F.col(result) if isinstance(result, str) else result, SEARCHED)
    lines = lambda of, text: F.array_join(F.filter(F.transform(of, text), lambda t: t.isNotNull()), "\n")
    title, explicit, summary = or_null(limited(stripped(r["display_title"]), 120)), or_null(r["searchable_text"]), or_null(r["summary"])
    new = lambda t: F.when(title.isNull() | (t != title), t)
    chapters = lines(r["chapters"], lambda c: F.when(or_null(c["title"]).isNotNull(), F.concat_ws(" ", or_null(c["title"]), or_null(c["summary"]))))
    parts = lambda e: F.filter(F.concat(F.array(e["caption"]), *[F.coalesce(e[k], F.array().cast("array<string>")) for k in ("visual", "audio", "actions", "entities")]), lambda t: or_null(t).isNotNull())
    events = lines(r["events"], lambda e: F.when(or_null(e["caption"]).isNotNull(), F.array_join(F.transform(parts(e), stripped), " ")))
    listed = F.concat_ws("\n", title, new(summary), or_null(chapters), or_null(events), or_null(lines(r["topics"], or_null)))
    return or_null(F.when(explicit.isNotNull(), F.concat_ws("\n", title, new(explicit))).otherwise(listed))


def assign_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Id {item}:{type}:{six digits}, by (item_id, chunk_type, ord); ord is also kept in metadata."""
    extra = F.to_json(F.map_from_arrays(F.array(F.lit("index")), F.array(F.col("ord").cast("string"))))
    return chunks.withColumn("id", F.format_string("%s:%s:%06d", "item_id", "chunk_type", "ord")).withColumn("metadata", F.coalesce("metadata", extra) if "metadata" in chunks.columns else extra)


def replace_item_chunks(chunks: DataFrame, new: DataFrame, only: str | None = None) -> DataFrame:
    """The items of new lose their rows (all but understanding, or only one type) and get new ones instead."""
    touched = new.select("item_id").distinct()
    if only is None:
        stays = chunks.where("chunk_type = 'understanding'").unionByName(chunks.where("chunk_type <> 'understanding'").join(touched, "item_id", "left_anti"))
    else:
        stays = chunks.where(F.col("chunk_type") != only).unionByName(chunks.where(F.col("chunk_type") == only).join(touched, "item_id", "left_anti"))
    return stays.unionByName(new, allowMissingColumns=True)


def media_duration(rows: DataFrame) -> DataFrame:
    """(item_id, duration_sec), the latest end or start."""
    return rows.groupBy("item_id").agg(F.max(F.greatest("start_sec", "end_sec")).alias("duration_sec"))


def display_title(metadata: str = "metadata", title: str = "title") -> Column:
    """B11."""
    return F.coalesce(json_text(metadata, "display_title"), or_null(title))


def display_transcript(chunks: DataFrame) -> DataFrame:
    """An item's lines if it has any, else its transcript or audio rows, else its document rows."""
    rank = F.when(F.col("chunk_type") == "transcript_line", 0).when(F.col("chunk_type").isin("transcript", "audio"), 1).when(F.col("chunk_type") == "document", 2)
    ranked = chunks.withColumn("rank_", rank).where("rank_ is not null")
    best = ranked.groupBy("item_id").agg(F.min("rank_").alias("rank_"))
    return ranked.join(best, ["item_id", "rank_"]).drop("rank_").select(chunks.columns)


def timed(result: Column) -> Column:
    """A JSON object's start, under either name."""
    return json_number(result, "start_sec", "start")
