"""Registered queries that run Structured Streaming to its end over the given tables, wave after wave, restarted between the waves.

Each wave's files are written before the stream is started from its checkpoint again; late and repeated rows come in later waves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import shared_path
from ..schemas import IGNORED
from ..sources.discovery import current_table, read_event_log
from ..sources.files import watch_files
from ..streaming import streams
from . import adapters as A
from .queries import NOW, query

#: Rows of each text file that stands for a document on disk, at most.
RECORDS = 50
#: Rows of a stream for each partition of its state, where that is more than a partition a core.
STATE_ROWS = 1_000_000


def _run(waves: list[Callable[[], None]], start: Callable[[], StreamingQuery]) -> None:
    """Each wave is written, then the stream takes what is new and ends; the next start goes on from its checkpoint."""
    for write in waves:
        write()
        start().awaitTermination()


@query("""
WITH e AS (SELECT *, date_diff('day', (SELECT min(ts) FROM events), ts) AS place FROM events WHERE ts IS NOT NULL)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS events, coalesce(sum(json_extract_string(props, '$.k')::BIGINT), 0)::BIGINT AS input_tokens,
       round(coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN value END), 0), 4) AS estimated_usd, count(*) FILTER (event_id % 7 = 0 OR value IS NULL) AS unpriced_events
FROM e WHERE NOT (event_id % 11 = 0 AND place < 5) GROUP BY 1""")
def usage_of_streamed_days(spark, sf_dir):
    """Usage by day from a stream of three waves in append mode with a watermark of a day.

    Every seventh row of the last half day of a wave comes a wave later, and counts; every eleventh of the first five days comes
    with the last wave, and is dropped; every fifth of the second wave comes twice, and counts once. Two rows far in the future
    close the last days.
    """
    base, rows = shared_path(spark), A.usage_events(spark, sf_dir).where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    first, n = rows.agg(F.date_trunc("day", F.min("ts")), F.count("*")).first()  # one row
    parts = max(spark.sparkContext.defaultParallelism, n // STATE_ROWS + 1)
    number, place = F.col("id").cast("long"), F.datediff("ts", F.lit(first))
    wave = F.least(F.floor(place / 10), F.lit(2))
    evening = (place % 10 == 9) & (F.hour("ts") >= 12) & (number % 7 == 0)
    wave = F.when((number % 11 == 0) & (place < 5), 2).otherwise(F.least(wave + F.when(evening, 1).otherwise(0), F.lit(2)))
    again = (number % 5 == 0) & (wave == 1)
    came = [rows.where(wave == 0), rows.where(wave == 1), rows.where((wave == 2) | again)]
    ends = [rows.limit(1).withColumns({"ts": F.lit(first) + F.expr("interval 1000 days"), "id": F.lit(f"end-{k}")}) for k in range(2)]
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    write = lambda part: lambda: part.write.mode("append").parquet(f"{base}/in")
    waves = [write(p) for p in (*came, *ends)]
    _run(waves, lambda: streams.to_files(streams.usage_stream(source(), "1 day", "1 day", "id"), f"{base}/out", f"{base}/checkpoint", parts))
    days = spark.read.parquet(f"{base}/out")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "events", "input_tokens", F.round("estimated_usd", 4).alias("estimated_usd"), "unpriced_events")


@query("""
WITH u AS (SELECT 'u-' || user_id AS item_id, floor(epoch(ts))::BIGINT AS updated_at, value - 5 AS position_sec FROM events WHERE value >= 5)
SELECT item_id, updated_at, round(position_sec, 6) AS position_sec FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC, position_sec DESC) AS n FROM u) WHERE n = 1""")
def streamed_positions(spark, sf_dir):
    """The latest valid playback position of every user, from updates that come in three waves, out of order and partly twice."""
    base, e = shared_path(spark), A.table(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("item_id"), F.unix_timestamp("ts").alias("updated_at"), (F.col("value") - 5).alias("position_sec"), "event_id")
    wave, again = (F.col("event_id") * 7) % 3, F.col("event_id") % 5 == 0
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    waves = [(lambda k=k: rows.where((wave == k) | (again & (wave + 1 == k))).write.mode("append").parquet(f"{base}/in")) for k in range(3)]
    _run(waves, lambda: streams.keep_positions(streams.playback_stream(source()), f"{base}/tables", f"{base}/checkpoint"))
    return current_table(spark, f"{base}/tables", "positions").select("item_id", "updated_at", F.round("position_sec", 6).alias("position_sec"))


@query("""
SELECT event_type AS stage, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS n_read_now, min(floor(epoch(ts))::BIGINT) FILTER (event_id % 4 <> 0) AS first FROM events GROUP BY event_type""")
def streamed_event_log(spark, sf_dir):
    """Events as JSON lines in two waves; lines without a time get that of the batch which reads them."""
    base, e = shared_path(spark), A.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 4 != 0, F.unix_timestamp("ts")).alias("ts"), F.lit("info").alias("level"), F.col("event_type").alias("stage")))
    started = spark.range(1).select(F.unix_timestamp(F.current_timestamp()).alias("at")).first()["at"]  # one row
    waves = [(lambda k=k: e.where(F.col("event_id") % 2 == k).select(line.alias("value")).write.mode("append").text(f"{base}/in")) for k in range(2)]
    _run(waves, lambda: streams.to_files(read_event_log(spark, f"{base}/in", NOW, streaming=True), f"{base}/out", f"{base}/checkpoint"))
    now = F.col("ts") >= started
    return spark.read.parquet(f"{base}/out").groupBy("stage").agg(F.count("*").alias("n"), F.count_if(now).alias("n_read_now"), F.min(F.when(~now, F.col("ts"))).alias("first"))


FILES_SQL = f"""
SELECT folder, sum((n + {RECORDS - 1}) // {RECORDS})::BIGINT AS files
FROM (SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS folder, doc_id % 6 AS bucket, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY folder"""


def write_files(documents: DataFrame, path: str) -> None:
    """Text files of at most RECORDS documents, in a folder for each source and bucket of ids; no source is written by one task."""
    rows = documents.select(F.regexp_replace("text", r"\s+", " ").alias("text"), "source", (F.col("doc_id") % 6).alias("bucket"))
    rows.repartition("source", "bucket").write.option("maxRecordsPerFile", RECORDS).partitionBy("source", "bucket").mode("append").text(path)


@query(FILES_SQL)
def watched_files(spark, sf_dir):
    """Files of documents that appear in three waves, watched and merged into a table of items, each once."""
    base, documents = shared_path(spark), A.table(spark, sf_dir, "documents")
    empty = A.document_items(spark, sf_dir).limit(0).withColumn("discovered_at", F.lit(None).cast("long"))
    dead = spark.createDataFrame([], IGNORED)
    spark.range(1).select(F.lit("x").alias("value")).write.text(f"{base}/library/node_modules")
    waves = [(lambda k=k: write_files(documents.where(F.col("doc_id") % 3 == k), f"{base}/library")) for k in range(3)]
    merge = streams.merge_discovered(f"{base}/tables", "watched", dead, empty, NOW)
    _run([*waves, lambda: None], lambda: streams.discover_stream(watch_files(spark, f"{base}/library", "document"), merge, f"{base}/checkpoint"))
    items = current_table(spark, f"{base}/tables", "items").where("status = 'discovered'")
    return items.groupBy(F.regexp_extract("raw_path", r"source=([^/]+)/", 1).alias("folder")).agg(F.count_distinct("id").alias("files"))
