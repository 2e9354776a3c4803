"""Tables between the steps of a long job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch of texts, at most.
BATCH_ROWS = 1_000
#: Bytes of texts, or words of lists, that a function in a task works on at once.
PORTION_BYTES, PORTION_WORDS = 2 << 20, 300_000


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share. Where it is unset, a local folder does on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored_as(df: DataFrame, form: str) -> str:
    """The path of the rows, written in that format."""
    path = shared_path(df.sparkSession)
    df.write.format(form).save(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written below spark.checkpoint.dir and read back: one computation for many readers, and a short plan."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_as(df, "parquet"))


def text_batches(df: DataFrame) -> DataFrame:
    """The same rows. The session's Arrow batches are held to BATCH_ROWS rows from here on, as texts may be long: plans read the setting when they run."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def portions(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about PORTION_BYTES bytes of a column of texts, or PORTION_WORDS of a column of lists; a longer row stands alone."""
    for batch in batches:
        c = batch.column(column)
        lists = pa.types.is_list(c.type)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(c) if lists else pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + (PORTION_WORDS if lists else PORTION_BYTES), "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])
