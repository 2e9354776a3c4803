"""What the operators of this subpackage share: tables in the shared folder, size-checked broadcasts, components, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a one-column key table may be broadcast (about 16 bytes a row).
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch of texts, at most.
BATCH_ROWS = 1_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the corpus contracts, for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset, a local folder does on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: By thread, the tables written by each operator at work, the outermost first.
_open: ContextVar[list[list[str]] | None] = ContextVar("open", default=None)


def _tables() -> list[list[str]]:
    if (held := _open.get()) is None:
        _open.set(held := [[]])
    return held


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once and read back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    _tables()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at the end, but for those that the yielded function was told to keep."""
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch_path)
        return df

    _tables().append([])
    try:
        yield keep
    finally:
        own = _tables().pop()
        remove(spark, [x for x in own if x not in kept])
        _tables()[-1].extend(x for x in own if x in kept)


def left_behind() -> list[str]:
    """Paths of the tables that finished operators of this thread kept for their results; forgets them."""
    paths, _tables()[0] = _tables()[0], []
    return paths


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, lengthened until no column of the frames has it; Spark tells no case apart."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df (already written) is counted to have at most so many rows; else df, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def bytes_of(c: str) -> Column:
    """The text as bytes; null counts as empty."""
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def texts_in_batches(df: DataFrame) -> DataFrame:
    """The same rows. Texts may be long, so the session's Arrow batches are held to BATCH_ROWS rows from here on: plans read the setting when they run."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def texts_of(documents: DataFrame) -> DataFrame:
    """(doc_id, text as bytes) for Arrow functions."""
    return texts_in_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of("text").alias("text"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer on 64-bit integers: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def portions(sizes: Iterable[int], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about so many bytes each; a longer row stands alone."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if total or i >= start:
        yield start, i + 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges: root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, shortens the chains by pointer jumping and
    contracts the edges; a star is gone after one round and no group is ever gathered. Null ends are dropped.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    with scratch(spark) as keep:
        edges = written(edges.union(edges.select("b", "a")).distinct())
        total = None
        while not edges.isEmpty():
            hook = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
            while True:
                up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
                jumped = written(hook.join(small(up), "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
                hook = jumped.select("node", "root")
                if jumped.where("moved").isEmpty():
                    break
            if total is None:
                total = jumped
            else:
                up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
                total = written(total.join(small(up), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            to_a, to_b = small(hook.toDF("a", "ra")), small(hook.toDF("b", "rb"))
            edges = written(edges.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        return keep(total if total is not None else edges).toDF(*(["node", "root", "moved"] if total is not None and len(total.columns) == 3 else ["node", "root"])).select("node", "root")


def positions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(*keys, *order, position): the place of each row among those of its keys (which may be null), from 0. order must be total.

    All rows are dealt to ranges of (keys, order), so no key is gathered. Within a range each key's rows are numbered, and a
    key that reaches over ranges adds what the ranges before hold of it, one number a range.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = written(rows.select(*keys, *order).repartitionByRange(n, *keys, *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A range has at most one key that began in an earlier one, so these are no more rows than ranges.
    begun = counts.withColumn("before", before).where("before is not null").select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("part").alias("part_"), "before")
    within = F.row_number().over(Window.partitionBy("part", *keys).orderBy(*order))
    same = F.col("part") == F.col("part_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    met = ranged.withColumn("within", within).join(F.broadcast(begun), same, "left")
    return met.select(*keys, *order, (F.col("within") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("position"))
