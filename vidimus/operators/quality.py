"""Quality measurement (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall, the share of the true k (query_id, point_key, rank) that results hold."""
    want = truth.where(F.col("rank") <= k).select("query_id", "point_key")
    got = results.where(F.col("rank") <= k).select("query_id", "point_key", F.lit(1).alias("hit")).distinct()
    return want.join(got, ["query_id", "point_key"], "left").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def relevance_eval(results: DataFrame, truth: DataFrame, k: int = 10, seconds: float = 5.0) -> DataFrame:
    """By query_type: recall@k, precision@k, nDCG@k, MRR and moment accuracy.

    results: query_id, id, rank, start_sec. truth: query_id, query_type, id, grade, start_sec, end_sec (times may be null).
    """
    good = truth.where("grade > 0")
    ideal = good.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).where(F.col("n") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("n") + 1.0)).alias("ideal"))
    asked = good.groupBy("query_id").agg(F.first("query_type").alias("query_type"), F.count("*").alias("relevant"))
    marks = good.select("query_id", "id", "grade", F.col("start_sec").alias("from_"), F.col("end_sec").alias("to_"))
    hits = results.where(F.col("rank") <= k).join(marks, ["query_id", "id"])
    on_time = F.when(F.col("from_").isNull(), None).otherwise(((F.col("start_sec") >= F.col("from_") - seconds) & (F.col("start_sec") <= F.coalesce("to_", "from_") + seconds)).cast("int"))
    each = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0)).alias("gain"), F.min("rank").alias("first"), F.max(on_time).alias("moment"))
    rows = asked.join(ideal, "query_id").join(each, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy("query_type").agg(
        F.count("*").alias("queries"), F.avg(zero(F.col("hits") / F.col("relevant"))).alias("recall"), F.avg(zero(F.col("hits") / k)).alias("precision"), F.avg(zero(F.col("gain") / F.col("ideal"))).alias("ndcg"), F.avg(zero(1 / F.col("first"))).alias("mrr"), F.avg("moment").alias("moment_accuracy")
    )


def quality_gate(current: DataFrame, baseline: DataFrame, metric: str = "ndcg", slack: float = 0.0) -> DataFrame:
    """One row: passed only if no query_type of the baseline is missing or worse."""
    both = baseline.select("query_type", F.col(metric).alias("was")).join(current.select("query_type", F.col(metric).alias("now")), "query_type", "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.when(F.col("was").isNull(), True).otherwise(F.coalesce(F.col("now") >= F.col("was") - slack, F.lit(False)))), F.lit(True)).alias("passed"))


#: Size of a quantile sketch, and the rank error that it keeps with 99 % confidence: 1.33 % of the values at 200, about 2.3 / k ** 0.9 in general.
SKETCH = 200


def percentile_report(samples: DataFrame, value: str, keys: list[str] | None = None, exact: bool = True) -> DataFrame:
    """N, mean, p50, p95 and p99: exact, which holds the distinct values of a group in one buffer, or by sketches of a fixed size."""
    if not exact:
        return sketched_percentiles(percentile_sketches(samples, value, keys), keys)
    p = lambda q, name: F.percentile(value, F.lit(q)).alias(name)
    return samples.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"))


def percentile_sketches(samples: DataFrame, value: str, keys: list[str] | None = None, k: int = SKETCH) -> DataFrame:
    """(*keys, n, total, sketch): a few kilobytes a group, however many values it has. Store them, and merge days with sketched_percentiles."""
    x = F.col(value).cast("double")
    return samples.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, keys: list[str] | None = None, k: int = SKETCH) -> DataFrame:
    """n, mean, p50, p95 and p99 of sketches merged by keys; each percentile is a value whose rank is off by the sketch's error at most."""
    merged = sketches.groupBy(*(keys or [])).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    held = F.kll_sketch_get_n_double("sketch")
    p = lambda q, name: F.when(held > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name)
    return merged.select(*(keys or []), "n", F.when(held > 0, F.col("total") / held).alias("mean"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"))
