"""Percentiles by mergeable sketches: within their rank error of the exact ones, small whatever the number of values."""

import bisect

from pyspark.sql import functions as F

from vidimus.operators import quality as J


def test_sketches_keep_their_rank_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("day"), F.exp(F.randn(3)).alias("ms"))
    rows = rows.unionByName(spark.createDataFrame([(0, 0, None), (5, 1, None)], "g long, day long, ms double"))
    exact = {r.g: r for r in J.percentile_report(rows, "ms", ["g"]).collect()}
    days = J.percentile_sketches(rows, "ms", ["g", "day"])
    assert days.agg(F.max(F.length("sketch"))).first()[0] < 10_000  # bytes, of 14,000 values of 8
    merged = {r.g: r for r in J.sketched_percentiles(days, ["g"]).collect()}
    assert merged.keys() == exact.keys() == {0, 1, 5}
    assert (merged[5].n, merged[5].p50, merged[5]["mean"]) == (1, None, None)
    for g in (0, 1):
        values = sorted(r.ms for r in rows.where(f"g = {g} AND ms IS NOT NULL").collect())
        assert merged[g].n == exact[g].n and abs(merged[g]["mean"] - exact[g]["mean"]) < 1e-9
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs(bisect.bisect_left(values, merged[g][name]) / len(values) - q) < 0.02
    assert J.percentile_report(rows, "ms", ["g"], exact=False).count() == 3
