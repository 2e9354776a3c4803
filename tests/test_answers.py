"""Answers cite the first three quotes, ranked before the rows get wide."""

from vidimus.operators import evidence as E
from vidimus.plans.media_queries import _hits

COLUMNS = "query_id long, rank int, unit_id string, item_title string, quote string, evidence_kind string, page long, section string, time_label string"


def test_first_quotes_of_every_query(spark):
    hits = [(1, 1, "a", "   "), (1, 2, "b", "two"), (1, 2, "b", ""), (1, 2, "b", "also two"), (1, 3, None, "three"), (1, 4, "d", "four"), (2, None, "e", "no rank"), (2, 1, "f", None), (2, 9, "g", "nine"), (3, 1, "h", " "), (None, 1, "i", "none asks")]
    rows = spark.createDataFrame([(q, r, u, "T", quote, "chunk", None, None, None) for q, r, u, quote in hits], COLUMNS)
    asked = spark.createDataFrame([(1, "en"), (2, "zh-CN"), (3, "en"), (4, None)], "query_id long, locale string")
    got = {r.query_id: (r.answer, r.citations) for r in E.extractive_answer(asked, rows).collect()}
    none = ("No evidence was found for this query.", [])
    assert got == {1: ("From your library: T: also two T: two T: three", ["b", "b", None]), 2: ("根据资料：T: no rank T: nine", ["e", "g"]), 3: none, 4: none}


def test_hits_are_ranked_while_narrow(spark, tmp_path):
    spark.range(3).selectExpr("id AS event_id", "id AS user_id", "'click' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    plan = _hits(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window", 1)
    assert "lorem" in above and "lorem" not in below
