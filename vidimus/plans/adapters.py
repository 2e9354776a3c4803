"""Projections of the given tables onto the data model, so that every query has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SEARCH_INDEX_VERSION
from ..sources.files import split_documents

CAPABILITY = {"click": "asr", "view": "embedding_text", "purchase": "embedding_image", "signup": "video_understanding", "error": "search_query"}
JOB_STATUS = {"click": "running", "view": "completed", "purchase": "queued", "signup": "cancelled", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_type(values: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.unix_timestamp("ts").alias("created_at"), "ts", F.when(F.col("event_id") % 2 == 0, "remote").otherwise("local").alias("provider_mode"), _by_type(CAPABILITY).alias("capability"),
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("item_id"), F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"), F.lit("ok").alias("status"), F.lit(1).cast("long").alias("request_count"),
        F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(0.0).alias("audio_seconds"), F.lit(0).cast("long").alias("image_count"), F.lit(0.0).alias("video_seconds"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("estimated_usd"), F.lit(0.0).alias("billed_credits"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status, started = _by_type(JOB_STATUS), F.unix_timestamp("ts")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("yt-dlp: HTTP Error "), (F.lit(400) + F.col("event_id") % 30).cast("string")))
    return e.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("item_id"), F.lit("index_video").alias("job_type"), status.alias("status"), started.alias("started_at"),
        F.when(~status.isin("running", "queued"), started + 60).alias("finished_at"), error.alias("error"), F.lit(0.5).alias("progress"), F.lit(None).cast("string").alias("stage"),
    )


def job_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each user of the events."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.unix_timestamp("ts")).alias("indexed_at"))
    return e.select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("user_id") % 3 == 0, "failed").otherwise("indexed").alias("status"), "indexed_at")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.lit(None).cast("string")
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("source_id"), F.lit("document").alias("content_type"), F.col("doc_id").cast("string").alias("external_id"), F.left("text", F.lit(80)).alias("title"), F.lit(None).cast("double").alias("duration_sec"),
        F.concat(F.lit("/library/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("raw_path"), (F.lit(1_700_000_000) + F.col("doc_id")).alias("indexed_at"), F.lit("indexed").alias("status"), text.alias("error"), text.alias("metadata"), F.lit(SEARCH_INDEX_VERSION).alias("search_index_version"), F.lit("indexed").alias("search_index_status"), "lang",
    )


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("created_at"))
    return d.select(F.col("source").alias("id"), F.lit("folder_document").alias("type"), F.concat(F.lit('{"path":"/library/'), "source", F.lit('"}')).alias("config"), F.lit("active").alias("status"), "created_at")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, whatever its length; operators with limits a chunk take document_pieces."""
    d = table(spark, sf_dir, "documents")
    item = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("double")
    return d.select(F.concat(item, F.lit(":document:000000")).alias("id"), item.alias("item_id"), F.lit("document").alias("chunk_type"), none.alias("start_sec"), none.alias("end_sec"), "text", F.lit(None).cast("string").alias("frame_path"), F.lit('{"page":1}').alias("metadata"))


def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every document in pieces: no text is longer than a chunk may be, and all of it is there."""
    d = table(spark, sf_dir, "documents")
    pieces = split_documents(d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.lit(1).alias("page"), "text"))
    none = F.lit(None).cast("double")
    return pieces.select(F.concat("item_id", F.lit(":document:"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("id"), "item_id", F.lit("document").alias("chunk_type"), none.alias("start_sec"), none.alias("end_sec"), "text", F.lit(None).cast("string").alias("frame_path"), F.to_json(F.struct("page", "section")).alias("metadata"))


def _conv():
    return F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(_conv().alias("item_id"), (12.0 * F.col("turn")).alias("start_sec"), (12.0 * F.col("turn") + 12).alias("end_sec"), "text", "turn")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame every second turn; a window of the conversation's turns without a frame is nearest to a neighbour's."""
    c = table(spark, sf_dir, "conversations").where("turn % 2 = 0")
    turn = F.col("turn").cast("string")
    return c.select(F.concat(_conv(), F.lit(":keyframe:"), F.lpad(turn, 6, "0")).alias("id"), _conv().alias("item_id"), F.lit("keyframe").alias("chunk_type"), (12.0 * F.col("turn") + 5).alias("start_sec"), (12.0 * F.col("turn") + 15).alias("end_sec"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("f-"), F.col("conv_id").cast("string"), F.lit("-"), turn, F.lit(".jpg")).alias("frame_path"), F.lit(None).cast("string").alias("metadata"))


def media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript rows of every turn, and the frames."""
    c = table(spark, sf_dir, "conversations")
    turn = F.lpad(F.col("turn").cast("string"), 6, "0")
    spoken = c.select(F.concat(_conv(), F.lit(":transcript:"), turn).alias("id"), _conv().alias("item_id"), F.lit("transcript").alias("chunk_type"), (12.0 * F.col("turn")).alias("start_sec"), (12.0 * F.col("turn") + 12).alias("end_sec"), "text", F.lit(None).cast("string").alias("frame_path"), F.lit(None).cast("string").alias("metadata"))
    return spoken.unionByName(frames(spark, sf_dir))


def media_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    text = F.lit(None).cast("string")
    return c.select(_conv().alias("id"), F.lit("talks").alias("source_id"), F.lit("video").alias("content_type"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), (12.0 * F.col("n")).alias("duration_sec"), text.alias("raw_path"), (F.lit(1_700_000_000) + F.col("conv_id")).alias("indexed_at"), F.lit("indexed").alias("status"), text.alias("metadata"), F.lit(SEARCH_INDEX_VERSION).alias("search_index_version"), F.lit("indexed").alias("search_index_status"))


def text_queries(spark: SparkSession, sf_dir: str, words: int | None = 3) -> DataFrame:
    """The first words of every benchmark text, or all of them."""
    b = table(spark, sf_dir, "benchmark")
    split = F.split("text", r"[ \n]+")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(split if words is None else F.slice(split, 1, words), " ").alias("q"), F.lit(10).alias("limit"), F.lit("smart").alias("preference"), F.lit(None).cast("array<float>").alias("query_vector"), F.lit("en").alias("locale"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_key"), F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("unit_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("item_id"), F.col("embedding").alias("vector"))
