"""Keys that reach over ranges, and sketches of many pairs at once."""

import numpy as np
import pyarrow as pa

from vidimus.llm import ngram_jaccard as N


def test_runs_of_a_range():
    rng = np.random.default_rng(2)
    rows = sorted(zip(rng.integers(0, 6, 60).tolist(), rng.integers(0, 9, 60).tolist(), strict=True))
    for size in (1, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]], pa.int64()), pa.array([c for _, c in rows[i : i + size]], pa.int64())], names=["key", "class"]) for i in range(0, 60, size)]
        got = [tuple(r.values()) for b in N._runs(iter(batches)) for r in b.to_pylist()]
        of_key = {}
        for k, c in rows:
            of_key.setdefault(k, [])
            if c not in of_key[k]:
                of_key[k].append(c)
        want = {(k, c, cs[0], cs[n]) for k, cs in of_key.items() for n, c in enumerate(cs[1:])}
        assert {r[:4] for r in got if not r[4]} == want
        assert [r[:4] for r in got if r[4]] == [(k, of_key[k][0], of_key[k][0], of_key[k][0]) for k in (rows[0][0], rows[-1][0])]
    assert list(N._runs(iter([]))) == []


def test_distances_of_many_pairs():
    rng = np.random.default_rng(3)
    sketches = [N.sketch(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))) for n in rng.integers(1, 400, 80)]
    pairs = rng.integers(0, 80, (300, 2))
    a, b = [sketches[i] for i, _ in pairs], [sketches[j] for _, j in pairs]
    assert N.distances(a, b).tolist() == [N.hamming(x, y) for x, y in zip(a, b, strict=True)]


def test_one_key_over_many_ranges(spark):
    """A family in one component although its keys are spread over ranges."""
    from .test_operators import VOCABULARY, docs

    base = VOCABULARY[:200]
    rows = [(k, " ".join(base[:k] + ["zz"] + base[k + 1 :]), "s") for k in range(120)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.component_id for r in N.ngram_jaccard(docs(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {0}
