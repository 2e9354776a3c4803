"""Postings summed up by term against brute force, with repeated and missing ids; without a shuffle of pairs of term and unit."""

import re
from collections import defaultdict

import pytest

from vidimus.operators import lexical as L

UNITS = [("a", "One two one"), ("b", "two three"), ("c", None), ("d", ""), (None, "two four"), (None, "four"), ("e", "one ONE, x9 two-two")]


def brute(units):
    out = defaultdict(lambda: [0, set(), 0, 0])
    for i, text in units:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for place, w in enumerate(words):
            t = out[w]
            t[0], t[2], t[3] = t[0] + 1, t[2] + place, t[3] + len(words)
            t[1].update([i] if i is not None else [])
    return {w: (n, len(held), places, lengths) for w, (n, held, places, lengths) in out.items()}


@pytest.mark.parametrize("more", [[], [("a", "two five"), ("a", "one"), ("e", "x9")]])
def test_totals(spark, more):
    got = L.term_totals(spark.createDataFrame(UNITS + more, "id string, content_text string"))
    assert {r.term: (r.n, r.units, r.places, r.lengths) for r in got.collect()} == brute(UNITS + more)


def test_pairs_of_term_and_unit_are_not_shuffled(spark, tmp_path):
    from vidimus.plans.media_queries import postings_by_term

    rows = [(k, " ".join(f"w{i}" for i in range(200)), "en", "s", 1) for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = postings_by_term(spark, str(tmp_path))
    assert {(r.n, r.units) for r in df.collect()} == {(100, 100)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(term#\d+, unit_id", plan)
