"""Structured Streaming forms: discovery (A2), event logs (A11), playback positions (F11), usage (H8).

Streams of rows go to a file sink, which takes each batch once; streams that change tables merge each batch into a snapshot
whose pointer carries the batch, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import measures
from ..sources.discovery import current_table, merge_batch, upsert_discovered


def discover_stream(files: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A2: every batch of new files goes to merge (which applies the discovery merge and writes the items)."""
    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_discovered(base: str, source_id: str, tombstones: DataFrame, empty: DataFrame, now: int, stream: str = "discovery") -> Callable[[DataFrame, int], None]:
    """For discover_stream: each batch of listed files (external_id, title, raw_path, content_type) is merged into the table items below base.

    empty: items before the first batch, with the columns of the table. Files are ordered by their path.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = batch.select(F.lit(source_id).alias("source_id"), "external_id", "raw_path", "title", "content_type", F.col("raw_path").alias("ord"))

        def change(last: dict | None) -> dict:
            items = current_table(spark, base, "items") if last else empty
            return {"items": (upsert_discovered(items, found, tombstones, now)[0], ())}

        merge_batch(spark, base, stream, number, change)

    return merge


def playback_stream(updates: DataFrame) -> DataFrame:
    """item_id, updated_at and position_sec of the latest valid update of each item; run in update or complete mode. State is one row an item."""
    good = updates.where((F.col("position_sec") >= 0) & ~F.isnan("position_sec"))
    return good.groupBy("item_id").agg(F.max(F.struct("updated_at", "position_sec")).alias("p")).select("item_id", "p.updated_at", "p.position_sec")


def keep_positions(positions: DataFrame, base: str, checkpoint: str, stream: str = "playback") -> StreamingQuery:
    """playback_stream in update mode, each batch merged once into the table positions below base."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def change(last: dict | None) -> dict:
            both = batch.unionByName(current_table(spark, base, "positions")) if last else batch
            return {"positions": (both.groupBy("item_id").agg(F.max(F.struct("updated_at", "position_sec")).alias("p")).select("item_id", "p.updated_at", "p.position_sec"), ())}

        merge_batch(spark, base, stream, number, change)

    return positions.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(events: DataFrame, window: str = "1 day", late: str = "1 hour", key: str | None = None) -> DataFrame:
    """H8: the usage measures over tumbling windows of the event time ts. Append mode: a window is given out once, when the watermark has passed it.

    Rows whose window the watermark has passed are dropped. key: events that repeat within the watermark count once.
    """
    events = events.withWatermark("ts", late)
    events = events if key is None else events.dropDuplicatesWithinWatermark([key])
    return events.groupBy(F.window("ts", window).alias("w")).agg(*measures()).select(F.col("w.start").alias("day"), "*").drop("w")


def to_files(df: DataFrame, path: str, checkpoint: str, parts: int | None = None) -> StreamingQuery:
    """Append mode to Parquet files; what is there is taken and the query ends. Started again, it goes on where it ended.

    parts: partitions of the stream's state, fixed by its first start, as each is read and written in every batch, however few rows
    come; else as many as the session's shuffles have.
    """
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    try:
        if parts is not None:
            conf.set(name, str(parts))
        return df.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
