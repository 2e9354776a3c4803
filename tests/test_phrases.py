"""Phrase search by the rarest term against brute force: with and without an index, with query tables too large to broadcast."""

import math
import random
import re

import pytest

from vidimus.operators import lexical as L

TOKEN = re.compile(r"[^\W_]+")


def brute(queries, units):
    docs = {i: [t.lower() for t in TOKEN.findall(text or "")] for i, text in units}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    places = lambda p, d: sum(d[i : i + len(p)] == p for i in range(len(d) - len(p) + 1))
    for q, text in queries:
        phrases = []
        for word in (text or "").split():
            p = TOKEN.findall(re.sub(r'^[^\w"-]+|[^\w"-]+$', "", word).lower())
            if p and p not in phrases:
                phrases.append(p)
        if not phrases:
            continue
        tf = {i: [places(p, d) for p in phrases] for i, d in docs.items()}
        df = [sum(places(p, d) > 0 for d in docs.values()) for p in phrases]
        for i, counts in tf.items():
            if all(counts):
                idf = [max(math.log((len(docs) - n + 0.5) / (n + 0.5)), L.LEAST_IDF) for n in df]
                out[q, i] = sum(w * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for w, c in zip(idf, counts, strict=True))
    return out


def corpus():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    weights = [200 / (k + 1) for k in range(40)]  # w0 is nearly everywhere
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    units = [(f"u{k:03}", text(rng.randint(0, 60))) for k in range(150)] + [("none", None), ("marks", "W0-w1, (w2)! w0_w1 w1-W0"), ("long", text(4_000))]
    asked = [text(rng.randint(1, 5)) for _ in range(40)] + ["w0", "w0-w1", '"w0-w1" w3', "w0-w1-w2 w0", "zzz w0", "", None, " ,. ", "w0 w0 W0", "w1-w1-w1", "w39-w38 w0"]
    return [(k, q) for k, q in enumerate(asked)], units


@pytest.mark.parametrize("way", ["direct", "shuffled", "indexed"])
def test_scores_equal_brute_force(spark, monkeypatch, way):
    asked, told = corpus()
    if way == "shuffled":
        monkeypatch.setattr(L, "FEW_QUERIES", 0)
    queries = spark.createDataFrame(asked, "query_id int, q string")
    units = spark.createDataFrame(told, "id string, content_text string").repartition(3)
    index = L.stored_index(units) if way == "indexed" else None
    got = {(r.query_id, r.unit_id): r.score for r in L.bm25_scores(queries, units, index=index).collect()}
    want = brute(asked, told)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())


def test_the_commonest_word_stores_no_places(spark, monkeypatch):
    """Every query holds the commonest word; what is stored between the steps grows with the queries and their hits alone."""
    units = spark.createDataFrame([(f"u{k}", "the " * 300 + f"name{k}") for k in range(300)], "id string, content_text string")
    queries = spark.createDataFrame([(k, f"the name{k}") for k in range(100)], "query_id int, q string")
    kept = []

    def counting(df):
        out = stored(df)
        kept.append(out.count())
        return out

    stored = L.stored
    monkeypatch.setattr(L, "stored", counting)
    assert L.bm25_scores(queries, units).count() == 100
    assert max(kept) <= 101


def test_texts_meet_queries_in_the_tasks_that_read_them(spark, monkeypatch):
    """Queries of common words alone: no pair of a text and a query is joined, and small blocks of queries give the same pairs."""
    asked, told = corpus()
    monkeypatch.setattr(L, "WANTED_BYTES", 60)
    units = spark.createDataFrame(told, "unit_id string, text string")
    wanted = spark.createDataFrame([(k, [["w0"], ["w1", "w0"]], "w1") for k in range(9)] + [(9, [["w2"]], "w2")], "key int, phrases array<array<string>>, term string")
    found = L._holding(wanted, units)
    assert "Join" not in found._jdf.queryExecution().toString()
    got = {(r.key, r.unit_id): r.tf for r in found.collect()}
    words = {i: [t.lower() for t in TOKEN.findall(text or "")] for i, text in told}
    pairs = {i: [t.count("w0"), sum(t[k : k + 2] == ["w1", "w0"] for k in range(len(t)))] for i, t in words.items()}
    assert got == {(k, i): n for i, n in pairs.items() if all(n) for k in range(9)} | {(9, i): [t.count("w2")] for i, t in words.items() if "w2" in t}
