"""A task of a search holds and hands on a bounded part of its pairs; empty sides of an interval join cost no join."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vidimus.operators import lexical as L
from vidimus.operators import units as C
from vidimus.operators import vectors as V


def test_many_queries_take_bounded_memory():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 8)).astype(np.float32), rng.standard_normal((20_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i:04d}" for i in range(len(x))]), pa.array(list(x), pa.list_(pa.float32()))], names=["point_key", "vector"])
    best = V.Best(5)
    tracemalloc.start()
    V.compared(batch, q, best, "cosine")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all scores at once are 480 MB
    queries, keys, score = best.rows()
    want = V.scores(q[-1:], x.astype(np.float64), "cosine")[0]
    assert set(keys[queries == len(q) - 1]) == {f"p{i:04d}" for i in np.argsort(-want)[:5]} and len(queries) == 5 * len(q)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_the_best_of_many_ties(monkeypatch, k):
    """Tiles in any order, most scores equal: the smaller keys stay, and few rows are held."""
    monkeypatch.setattr(V, "HELD", 500)
    rng = np.random.default_rng(k)
    score, keys = rng.integers(0, 4, (7, 900)) / 4, np.array([f"k{i:03d}" for i in rng.permutation(900)], object)
    best, most = V.Best(k), 0
    for at in range(0, 900, 20):
        for first in (0, 4):
            best.add(np.arange(first, min(first + 4, 7)), keys[at : at + 20], score[first : first + 4, at : at + 20])
        most = max(most, sum(len(h[0]) for h in best.held))
    queries, found, _ = best.rows()
    for i in range(7):
        assert sorted(found[queries == i]) == sorted(sorted(keys, key=lambda c, i=i: (-score[i][list(keys).index(c)], c))[:k])
    assert most <= 2 * max(500, 7 * k) + 2 * 80


def test_interval_join_without_long_rows(spark):
    rows = spark.createDataFrame([("a", "i", 0.0, 12.0), ("b", "i", 40.0, 52.0)], "id string, item_id string, eff_start double, eff_end double")
    windows = spark.createDataFrame([("i", 0, 0.0, 30.0), ("i", 1, 25.0, 55.0)], "item_id string, k int, window_start double, window_end double")
    found = C.interval_overlap_join(rows, windows)
    assert found._jdf.queryExecution().analyzed().toString().count("Join") == 1
    assert {(r.id, r.k) for r in found.collect()} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize(("many", "digits"), [(200, "02468"), (100, "0124689"), (100, "02468")])
def test_tasks_hand_on_a_pool_of_the_searchable(spark, monkeypatch, many, digits):
    """Queries of the commonest word: a task hands on four times the limit, of the units that may be found; few of them, few others, or many of both."""
    monkeypatch.setattr(L, "FEW_QUERIES", many)
    told = [(f"u{k:03d}", "the " * (k % 3 + 1) + f"w{k}") for k in range(300)] + [(None, "the the")]
    units = spark.createDataFrame(told, "id string, content_text string").repartition(3)
    queries = spark.createDataFrame([(k, "the", 1) for k in range(5)], "query_id int, q string, limit int")
    allowed = units.where(units.id.substr(4, 1).isin(list(digits))).select(units.id.alias("unit_id"))
    every = {(r.query_id, r.unit_id): r.score for r in L.bm25_scores(queries, units).collect()}
    assert len(every) == 5 * 301
    few = L.bm25_scores(queries, units, searchable=allowed, most=4).collect()
    plain = L.bm25_scores(queries, units, searchable=allowed)
    assert len(few) <= 5 * 4 * 3 if (many, digits) != (100, "02468") else len(few) == plain.count() == 5 * 150
    assert all(r.score == every[r.query_id, r.unit_id] for r in few)
    found = L.bm25_search(queries, units, allowed).collect()
    want = sorted((c for q, c in every if q == 0 and c and c[3] in digits), key=lambda c: (-every[0, c], c))[:4]
    assert [r.unit_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 3] == want and len(found) == 20
    assert len(L.bm25_search(queries, units).collect()) == 20
