"""The inverted file: recall against brute force, lists that are never read, compact codes, awkward vectors."""

from pathlib import Path

import numpy as np
import pytest

from vidimus.operators import ann as A
from vidimus.operators import quality as J
from vidimus.operators import vectors as V


def clustered(spark, n, dim, groups, asked, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    x = (centres[rng.integers(0, groups, n)] + rng.normal(0, 0.6, (n, dim))).astype(np.float32)
    q = x[rng.integers(0, n, asked)] + rng.normal(0, 0.2, (asked, dim)).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "point_key long, vector array<float>")
    queries = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(q)], "query_id string, query_vector array<float>")
    return queries, vectors, x.astype(np.float64), q.astype(np.float64)


def brute(q, x, k):
    score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    return {f"q{i}": np.lexsort((np.arange(len(x)), -score[i]))[:k].tolist() for i in range(len(q))}


@pytest.mark.parametrize(("n", "dim", "groups", "lists"), [(6_000, 64, 60, 60), (1_500, 2_048, 30, 40)])
def test_recall_with_a_tenth_of_the_lists(spark, n, dim, groups, lists):
    queries, vectors, x, q = clustered(spark, n, dim, groups, 40)
    index = A.inverted_file(vectors, lists, sample=n // 2)
    found = A.ann_topk(queries, None, 10, probes=len(index.centres) // 10, index=index).collect()
    want = brute(q, x, 10)
    assert sum(r.point_key in want[r.query_id] for r in found) >= 0.9 * 10 * len(q)
    for r in found:  # what is returned is compared exactly
        a, b = q[int(r.query_id[1:])], x[r.point_key]
        assert abs(r.similarity - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-6
    # The scan reads at most an eighth of the vectors' bytes; all of them make up the table.
    codes = spark.read.parquet(f"{index.path}/tiles").selectExpr("sum(length(codes)) AS bytes", "sum(size(keys)) AS n").first()
    assert codes.n == n and codes.bytes * 8 <= x.size * 4
    assert A.open_inverted_file(spark, index.path).probes == index.probes < len(index.centres)


def test_lists_that_no_query_probes_are_never_read(spark):
    queries, vectors, x, q = clustered(spark, 3_000, 32, 30, 3)
    index = A.inverted_file(vectors, 30)
    before = sorted(map(tuple, A.ann_topk(queries, None, 10, probes=2, index=index).collect()))
    probed = set(A.ranked_lists(q, index.centres, 2).ravel().tolist())
    assert len(probed) <= 6 < len(index.centres)
    spoiled = 0
    for part in ("tiles", "vectors"):
        for folder in Path(index.path.removeprefix("file:"), part).glob("list=*"):
            if int(folder.name[5:]) not in probed:
                for file in folder.glob("*.parquet"):
                    (folder / f".{file.name}.crc").unlink(missing_ok=True)
                    file.write_bytes(b"no parquet")
                    spoiled += 1
    assert spoiled >= 2 * (len(index.centres) - 6)
    assert sorted(map(tuple, A.ann_topk(queries, None, 10, probes=2, index=index).collect())) == before
    with pytest.raises(Exception, match="parquet|Parquet|PARQUET"):
        A.ann_topk(queries, None, 10, probes=len(index.centres), index=index).collect()


def test_all_lists_are_the_exact_search(spark):
    queries, vectors, x, q = clustered(spark, 900, 33, 5, 20)
    index = A.inverted_file(vectors, 12)
    got = {}
    for r in A.ann_topk(queries, None, 10, probes=99, index=index, pool=300).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.point_key
    assert {i: [found[k] for k in range(1, 11)] for i, found in got.items()} == brute(q, x, 10)
    exact = V.vector_topk(queries, vectors, 10)
    assert J.recall_at_k(A.ann_topk(queries, None, 10, index=index), exact, 10).first()[0] >= 0.9


def test_large_query_tables_and_pools_are_joined_by_shuffle(spark, monkeypatch):
    queries, vectors, x, q = clustered(spark, 600, 16, 6, 30)
    index = A.inverted_file(vectors, 8)
    few = sorted(map(tuple, A.ann_topk(queries, None, 5, probes=3, index=index).collect()))
    monkeypatch.setattr(A, "HINT_BYTES", 0)
    monkeypatch.setattr(A, "HINT_ROWS", 0)
    assert sorted(map(tuple, A.ann_topk(queries.repartition(5), None, 5, probes=3, index=index).collect())) == few


def test_lists_are_balanced_and_codes_are_close(spark):
    rng = np.random.default_rng(2)
    # Nine tenths of the vectors lie around one direction.
    x = np.concatenate([rng.standard_normal((1, 24)) * 4 + rng.standard_normal((2_700, 24)), rng.standard_normal((300, 24)) * 5])
    features = spark.createDataFrame([((v / np.linalg.norm(v)).tolist(),) for v in x], "features array<double>")
    centres, sizes = A.balanced_centres(features, 30)
    assert sizes.sum() == len(x) and sizes.max() <= 2 * A.BALANCE * len(x) / 30
    residuals = rng.standard_normal((2_000, 23)) * np.linspace(0.1, 3, 23)
    steps = A.STEP * residuals.std(axis=0)
    error = A.decoded(A.encoded(residuals, steps), steps) - residuals
    assert (error**2).mean() < 0.015 * (residuals**2).mean()
    assert A.encoded(residuals, steps).shape == (2_000, 12)


def test_awkward_vectors(spark):
    dim = 5
    rows = [("a", [1.0, 2.0, 3.0, 4.0, 5.0]), ("a", [1.0, 2.0, 3.0, 4.0, 5.0]), ("b", [1.0, 2.0, 3.0, 4.0, 5.0]), ("zero", [0.0] * dim), ("none", None), ("hole", [None, *[1.0] * 4]), ("nan", [float("nan")] * dim), ("short", [1.0]), ("c", [5.0, 4.0, 3.0, 2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "point_key string, vector array<float>")
    index = A.inverted_file(vectors)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, None), (3, [1.0]), (4, [0.0] * dim)], "query_id int, query_vector array<float>")
    got = {}
    for r in A.ann_topk(queries, None, 4, probes=99, index=index).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.point_key, round(r.similarity, 6)))
    assert [s for _, s in got[1][:3]] == [1.0] * 3 and {p for p, _ in got[1][:3]} <= {"a", "b"} and set(got) == {1, 4}
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "point_key long, vector array<float>")
    assert A.ann_topk(spark.createDataFrame([(1, [2.0, 2.0])], "query_id int, query_vector array<float>"), same, 3).count() == 3
    empty = spark.createDataFrame([], "point_key long, vector array<float>")
    assert A.ann_topk(queries, empty, 3).collect() == []
