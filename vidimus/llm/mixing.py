"""Mixing sources to target weights by hash-threshold histograms: DataFrame functions only.

Tokens are summed by source and hash bucket, the bucket in which a source's budget ends is found in the running sum and
refined alone, level by level, until one hash value is left. Documents with a smaller hash are in: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch, small, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Bits of the hash that each level of the histogram resolves.
LEVELS = (12, 10, 10)


def words_in(c: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(c: Column) -> Column:
    """32 bits of a digest: the same for equal ids at every run."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): the budget dealt by weight, no target above repeats times its source's size."""
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    parts = sources.groupBy("part").count()  # as many rows as partitions
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = written(sources.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"), (repeats * F.col("source_size")).alias("most")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # each round reshares what the stopped sources leave; they stay stopped, as the level only rises
        over = F.col("most") < level * F.col("weight")
        stopped, open_weight = sources.agg(F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        new = (share * total - stopped) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return sources.select("source", "source_size", F.least(level * F.col("weight"), F.col("most").cast("double")).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of documents.

    size counts the words that ASCII white space separates, null texts have 0. Sources weigh by their place in code point
    order, null last as a source of its own. Every document is taken floor(target / source_size) times, and once more if
    its digest is below its source's threshold; so taken is a multiple of size, at most repeats times it. Rows that share
    a doc_id are taken alike, null ids too. Of the two thresholds around a budget the nearer one holds, the lower on a
    tie. Only doc_id, text and source are read. An empty table gives an empty result.
    """
    with scratch(documents.sparkSession) as keep:
        sized = keep(written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in("text").alias("size")).withColumn("draw", drawn(F.col("doc_id")))))
        targets = written(source_targets(sized, weights, share, repeats).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)))
        hint = small(targets)
        # within: what is left of the budget at this level; low: the first draw of the bucket that is refined
        edge = targets.select(F.col("source").alias("of"), (F.col("target") - F.col("times") * F.col("source_size")).alias("within"), F.lit(0).cast("long").alias("low"))
        bits = sum(LEVELS)
        for width in LEVELS:
            span = 1 << bits
            bits -= width
            edge = small(written(edge.select("of", "within", "low")))
            inside = sized.join(edge, F.col("source").eqNullSafe(F.col("of"))).where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("low") + span))
            bucket = F.shiftright(F.col("draw") - F.col("low"), bits)
            sums = inside.groupBy("of", "within", "low", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
            upto = F.sum("size").over(Window.partitionBy("of").orderBy("bucket"))
            sums = sums.withColumn("before", upto - F.col("size")).where((F.col("before") <= F.col("within")) & (F.col("before") + F.col("size") > F.col("within")))
            edge = sums.select("of", (F.col("within") - F.col("before")).alias("within"), (F.col("low") + F.shiftleft("bucket", bits)).alias("low"), "size")
        edge = edge.select("of", (F.col("low") + F.when(F.col("size") - F.col("within") < F.col("within"), 1).otherwise(0)).alias("below"))
        rules = hint.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("s"), "source_size", "target", "times", F.coalesce("below", F.lit(0)).alias("below"))
        rules = keep(written(rules))
    rules = small(rules)
    taken = F.col("size") * (F.col("times") + F.when(F.col("draw") < F.col("below"), 1).otherwise(0))
    return sized.join(rules, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
