"""Interval and as-of joins of one item that holds all rows: equal to naive loops, and spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_library import naive_overlap
from vidimus.functions.text import clock
from vidimus.operators import library as LIB
from vidimus.operators import units as C

DAY = 86_400.0


def intervals(rng, n, missing):
    out = []
    for k in range(n):
        start = None if rng.random() < missing else round(rng.uniform(-100, DAY), 1)
        size = rng.choice([0, 0.5, 20, 30, 200, 260, 4_000, 40_000, 80_000])
        out.append((k, start, None if start is None or rng.random() < 0.1 else start + size))
    return out


def test_a_day_of_short_and_long_rows(spark):
    rng = random.Random(12)
    rows, windows = intervals(rng, 400, 0.02), intervals(rng, 250, 0.02)
    a = spark.createDataFrame([("day", *r) for r in rows] + [("other", 9_000, 5.0, 50_000.0)], "item_id string, id int, eff_start double, eff_end double")
    b = spark.createDataFrame([("day", *w) for w in windows] + [("third", 9_000, 5.0, 50_000.0)], "item_id string, k int, window_start double, window_end double")
    joined = C.interval_overlap_join(a, b)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert joined.columns == [*a.columns, "k", "window_start", "window_end"]
    got = sorted((r.id, r.k) for r in joined.collect())
    assert got == sorted((i, k) for i, s, e in rows for k, ws, we in windows if naive_overlap(s, e, ws, we))


@pytest.mark.parametrize("top", [24, 5])
def test_nodes_cover_each_bin_once(spark, monkeypatch, top):
    monkeypatch.setattr(C, "TOP", top)
    rng = random.Random(1)
    ranges = [(low, low + rng.choice([0, 1, 7, 8, 100, 3_000])) for low in (rng.randint(-200, 5_000) for _ in range(300))]
    df = spark.createDataFrame(ranges, "low_ long, high_ long").withColumn("nodes", C._nodes("low_", "high_"))
    for r in df.collect():
        bins = sorted(b for n in r.nodes for b in range(n.node << n.level, (n.node + 1) << n.level))
        assert bins == list(range(r.low_, r.high_ + 1)) and (top == 5 or len(r.nodes) <= 24)


@pytest.mark.parametrize("following", [False, True])
def test_one_item_with_all_frames(spark, following):
    rng = random.Random(5)
    frames = [("day", f"f{k:04}", float(t)) for k, t in enumerate(sorted(rng.sample(range(4_000), 700)))] + [("day", "same", 100.0), ("day", "null", None), ("untimed", "u2", None), ("untimed", "u1", None)]
    targets = [("day", f"t{k}", None if k % 50 == 0 else rng.randint(-50, 8_100) / 2) for k in range(900)] + [("untimed", "x", 5.0), ("none", "y", 5.0)]
    f = spark.createDataFrame([(*x, f"/{x[1]}") for x in frames], "item_id string, id string, start_sec double, frame_path string")
    t = spark.createDataFrame([(*x, 7) for x in targets], "item_id string, target_id string, at double, extra int")
    got = {r.target_id: (r.frame_id, r.extra) for r in C.nearest_frame_asof(t, f, following).collect()}
    timed = [x for x in frames if x[0] == "day" and x[2] is not None]
    for item, name, at in targets:
        if item == "day":
            want = min(timed, key=lambda x: (x[2], x[1]) if at is None else (abs(x[2] - at), -x[2] if following else x[2], x[1]))[1]
        else:
            want = {"untimed": "u1", "none": None}[item]
        assert got[name] == (want, 7), (name, at)
    assert len(got) == len(targets)


def test_one_item_spreads_over_tasks(spark, monkeypatch):
    kept = []
    stored = C.stored
    monkeypatch.setattr(C, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    rows = spark.range(8_000).select(F.lit("day").alias("item_id"), F.col("id").cast("string").alias("target_id"), (F.col("id") * 1.5).alias("at"))
    marks = spark.range(2_000).select(F.lit("day").alias("item_id"), F.col("id").cast("string").alias("id"), (F.col("id") * 6.0).alias("start_sec"), F.lit("p").alias("frame_path"))
    assert C.nearest_frame_asof(rows, marks).where("at <= 11994 AND abs(frame_start - at) > 3").count() == 0
    sizes = [r["count"] for r in kept[0].groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4


def test_chunk_for_time_equals_a_loop(spark):
    rng = random.Random(8)
    chunks = [("day", f"c{k:03}", rng.choice([None, float(rng.randint(0, 600)), rng.uniform(0, 600)])) for k in range(300)] + [("b", "z", None)]
    name = lambda s: f"{int(s) // 60}:{int(s) % 60:02}"
    targets = [(f"t{k}", "day", rng.uniform(-10, 700), rng.choice([None, f"c{rng.randint(0, 400):03}", "z"]), rng.choice([None, "zzz", name(rng.randint(0, 600))])) for k in range(300)] + [("e", "b", 1.0, None, None), ("g", "b", 1.0, "z", None), ("n", "day", None, None, None)]
    c = spark.createDataFrame(chunks, "item_id string, id string, start_sec double")
    assert {r[0]: r[1] for r in c.select("start_sec", clock("start_sec")).where("start_sec is not null").collect()} == {s: name(s) for _, _, s in chunks if s is not None}
    t = spark.createDataFrame(targets, "target_id string, item_id string, at double, preferred_id string, label string")
    got = {r.target_id: r.chunk_id for r in LIB.nearest_chunk_for_time(t, c).collect()}
    for target, item, at, preferred, label in targets:
        own = [(i, s) for x, i, s in chunks if x == item]
        order = lambda x: (abs(x[1] - at) if at is not None else 0, x[1], x[0])
        timed = [x for x in own if x[1] is not None]
        labelled = [x for x in timed if name(x[1]) == label]
        want = preferred if preferred in {i for i, _ in own} else min(labelled or timed, key=order)[0] if timed else None
        assert got[target] == want, target
    assert len(got) == len(targets)
