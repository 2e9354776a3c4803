"""The merge of discovered items against a loop that applies one row after another, and batches that are merged once."""

import random

import pytest
from pyspark.sql import functions as F

from vidimus.functions import pointers
from vidimus.functions.graphs import components
from vidimus.sources import discovery as D

ITEMS = "id string, source_id string, content_type string, external_id string, title string, raw_path string, indexed_at long, status string, error string, discovered_at long, extra int"
FOUND = "source_id string, external_id string, raw_path string, title string, content_type string, ord int"
DEAD = "source_id string, external_id string, raw_path string"
NAMES = [c.split()[0] for c in ITEMS.split(", ")]


def one_after_another(items, found, dead, now):
    held, changed = [dict(zip(NAMES, x, strict=True)) for x in items], set()
    for source, external, raw, title, kind, _ in sorted(found, key=lambda r: r[5]):
        path = (raw or "").strip() or None
        if any(s == source and (e == external or (path is not None and p == path)) for s, e, p in dead):
            continue
        same = [x for x in held if (x["source_id"], x["external_id"]) == (source, external)]
        live = [x for x in same if x["status"] != "deleting"]
        at = [x for x in held if path and x["source_id"] == source and x["raw_path"] == path and x["status"] != "deleting"]
        if not live and at:
            x = min(at, key=lambda x: ({"indexed": 0, "processing": 1, "fetching": 2}.get(x["status"], 3), x["id"]))
            changed.add(x["id"])
            if x["status"] not in ("fetching", "processing"):
                x["status"], x["indexed_at"] = "discovered", None
        elif same:
            x = same[0]
            x["status"] = "indexed" if x["status"] == "indexed" else "discovered"
        else:
            x = dict.fromkeys(NAMES) | {"id": f"{source}:{external}", "source_id": source, "status": "discovered"}
            while any(y["id"] == x["id"] for y in held):
                x["id"] += "'"
            held.append(x)
        x |= {"external_id": external, "raw_path": raw, "title": title, "content_type": kind, "error": None}
        x["discovered_at"] = x["discovered_at"] or now
    return sorted(tuple(x[n] for n in NAMES) for x in held), sorted(changed)


def merged(spark, items, found, dead):
    out, changed = D.upsert_discovered(spark.createDataFrame(items, ITEMS), spark.createDataFrame(found, FOUND), spark.createDataFrame(dead, DEAD), 99)
    return sorted(map(tuple, out.collect()), key=str), sorted({r.item_id for r in changed.collect()})


@pytest.mark.parametrize("seed", range(4))
def test_shared_ids_and_paths_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    items, found, used = [], [], set()
    states = ["indexed", "indexed", "processing", "fetching", "discovered", "failed", "deleting"]
    many = 60 if seed < 2 else 12  # few names: long components
    for i in range(40):
        source, external = f"s{rng.randint(0, 1)}", rng.choice([None, *[f"e{k}" for k in range(many)]])
        if external is not None and (source, external) in used:
            continue
        used.add((source, external))
        status = rng.choice(states)
        items.append((f"i{i:02}", source, "video", external, f"t{i}", rng.choice([None, *[f"/p{k}" for k in range(many)]]), 5 if status == "indexed" else None, status, rng.choice([None, "bad"]), rng.choice([None, 7]), i))
    gone = {(x[1], x[3]) for x in items if x[7] == "deleting"}
    for k in range(50):
        source, external = f"s{rng.randint(0, 1)}", f"e{rng.randint(0, many + 5)}"
        if (source, external) in gone:  # a unique key of the item table would forbid some of these moves
            continue
        found.append((source, external, rng.choice([None, " ", f"/p{rng.randint(0, many)}", f" /p{rng.randint(0, many)}"]), f"n{k}", "audio", k))
    dead = [("s0", "e3", None), ("s1", "zz", "/p4")]
    want, changed = one_after_another(items, found, dead, 99)
    assert merged(spark, items, found, dead) == (sorted(want, key=str), changed)


def test_one_item_for_two_rows_of_a_path(spark):
    item = ("i1", "s", "video", "e1", "t", "/p", 5, "indexed", None, 1, 0)
    out, changed = merged(spark, [item], [("s", "e2", "/p", "b", "video", 0), ("s", "e3", "/p", "c", "video", 1)], [])
    assert [(x[0], x[3], x[5]) for x in out] == [("i1", "e3", "/p")] and changed == ["i1"]
    out, _ = merged(spark, [], [("s", "e2", "/p", "b", "video", 0), ("s", "e3", "/p", "c", "video", 1)], [])
    assert [(x[0], x[3]) for x in out] == [("s:e2", "e3")]
    assert merged(spark, [], [], []) == ([], [])
    out, _ = merged(spark, [item[:7] + ("deleting",) + item[8:]], [("s", "e2", "/p", "b", "video", 0)], [])
    assert sorted((x[0], x[7]) for x in out) == [("i1", "deleting"), ("s:e2", "discovered")]
    out, _ = merged(spark, [item], [("s", "e1", "  ", "b", "video", 0), ("s", "e9", " /p ", "c", "video", 1)], [])
    assert sorted((x[0], x[3], x[7]) for x in out) == [("i1", "e1", "indexed"), ("s:e9", "e9", "discovered")]


def test_components(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randint(0, 90):02}", f"n{rng.randint(0, 90):02}") for _ in range(70)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)]
    up = {x: x for link in links for x in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()} == {x: root(x) for x in linked}


def test_a_batch_is_merged_once_and_a_killed_one_again(spark, tmp_path):
    base = str(tmp_path / "tables")

    def adding(n, fail=False):
        def change(last):
            before = D.current_table(spark, base, "t") if last else spark.createDataFrame([], "n int")
            both = before.union(spark.createDataFrame([(n,)], "n int"))
            return {"t": (both.withColumn("n", F.expr("n + raise_error('killed')")) if fail else both, ())}

        return change

    held = lambda: sorted(r.n for r in D.current_table(spark, base, "t").collect())
    assert D.merge_batch(spark, base, "a", 0, adding(1)) and held() == [1]
    with pytest.raises(Exception, match="killed"):
        D.merge_batch(spark, base, "a", 1, adding(2, fail=True))
    assert held() == [1]
    assert D.merge_batch(spark, base, "a", 1, adding(2)) and held() == [1, 2]
    assert not D.merge_batch(spark, base, "a", 1, adding(2)) and not D.merge_batch(spark, base, "a", 0, adding(1)) and held() == [1, 2]
    assert D.merge_batch(spark, base, "b", 0, adding(3)) and held() == [1, 2, 3]


def test_two_writers_leave_one_winner(spark, tmp_path):
    base = str(tmp_path / "tables")
    table = lambda n: {"t": (spark.createDataFrame([(n,)], "n int"), ())}
    assert D.publish_snapshot(spark, base, 1, table(1))
    assert D.publish_snapshot(spark, base, 2, table(2))
    assert not D.publish_snapshot(spark, base, 2, table(3))  # began with the same number, came later
    assert [r.n for r in D.current_table(spark, base, "t").collect()] == [2]
    assert len(list((tmp_path / "tables").glob("snapshot=*"))) == 2 and pointers.latest(spark, base)["number"] == 2
    tried = []

    def change(last):  # another writer is first, so this one is asked again
        tried.append(last["number"])
        if len(tried) == 1:
            D.publish_snapshot(spark, base, 3, table(7))
        return {"t": (D.current_table(spark, base, "t").union(spark.createDataFrame([(8,)], "n int")), ())}

    assert D.merge_batch(spark, base, "a", 0, change) and tried == [2, 3]
    assert sorted(r.n for r in D.current_table(spark, base, "t").collect()) == [7, 8]
