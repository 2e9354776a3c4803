"""The row that answers a hit best: found right, and with a plan that stays short."""

from vidimus.operators import ranking as R


def test_the_plan_of_the_best_line_is_short(spark):
    hits = spark.createDataFrame([(1, "u1", "beta", "i", 0.0, 30.0), (2, "u1", "zeta", "i", 0.0, 30.0)], "query_id int, unit_id string, q string, item_id string, start_sec double, end_sec double")
    rows = [(f"t{k}", "i", "transcript", 10.0 * k, 10.0 * k + 10, t) for k, t in enumerate(("alpha", "beta", "gamma"))]
    chunks = spark.createDataFrame(rows, "id string, item_id string, chunk_type string, start_sec double, end_sec double, text string")
    found = R.best_spoken_line(hits, chunks)
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert {(r.query_id, r.spoken_id) for r in found.collect()} == {(1, "t1"), (2, "t0")}
