"""Whitening against a dense eigensolver, and the contour integration on hard spectra."""

import math

import numpy as np
import pytest

from vidimus.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, n int, deviation string, w int"


def reference(rows, k=8):
    size = max({len(v) for _, v in rows}, key=lambda s: (sum(len(v) == s for _, v in rows), -s))
    rows = [(i, v) for i, v in rows if len(v) == size]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in rows], n, deviation, centred @ axes / np.sqrt(values), values / np.trace(v)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("n", "d"), [(300, 12), (40, 5), (200, 33)])
def test_equals_a_dense_solver(spark, n, d):
    rng = np.random.default_rng(n)
    good = [(int(i), v.tolist()) for i, v in enumerate(rng.standard_normal((n, d)) * np.linspace(3, 0.1, d) + rng.standard_normal(d))]
    good += [good[0], (None, good[1][1]), (5, good[2][1])]
    bad = [(900, None), (901, []), (902, [math.nan] * d), (903, [None, *[1.0] * (d - 1)]), (904, [math.inf] * d), (905, [1e300] * d), (906, [1.0] * (d + 1)), (907, [1.0])]
    got = W.whitening(frame(spark, good + bad).repartition(7)).collect()
    ids, total, deviation, white, explained = reference(good)
    assert len(got) == len(good) * min(8, d) and {r.n for r in got} == {total}
    assert max(r.identity_error for r in got) == min(r.identity_error for r in got) < 1e-9
    want = sorted((i is None, i or 0, k + 1, y, round(w[k], 6)) for i, y, w in zip(ids, deviation, white, strict=True) for k in range(len(w)))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.deviation, round(r.whitened, 6)) for r in got) == want
    for r in got:
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)


def test_few_directions_and_degenerate_tables(spark):
    rng = np.random.default_rng(3)
    flat = [(i, (rng.integers(-50, 50, 2) @ np.array([[1, 0, 1, 1], [0, 1, 1, -1]])).astype(float).tolist()) for i in range(50)]
    got = W.whitening(frame(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert W.whitening(frame(spark, rows)).collect() == []
    # Lengths that are equally common: the shorter one is fitted.
    assert {r.vec_id for r in W.whitening(frame(spark, [(1, [0.0, 3.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, [0.0]), (4, [1.0])])).collect()} == {3, 4}


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(x), -float(x)]) for i, x in enumerate([0, 1, 1e6, 2_000_000, 5])]
    got = {r.vec_id: r.deviation for r in W.whitening(frame(spark, rows)).collect()}
    for (i, n), y in zip(enumerate([0] * 5), reference(rows)[2], strict=True):
        assert got[i] == (y if y < 2**63 else None)
    assert None in got.values() and any(got.values())


def spectra():
    rng = np.random.default_rng(8)
    for d in (1, 2, 3, 9, 30, 64):
        yield np.ones(d)
        yield np.arange(1, d + 1) ** -4.0
        yield 1 + 1e-3 * rng.random(d)
        yield 10.0 ** rng.uniform(-9, 3, d)
        yield np.concatenate([rng.random(-(-d // 2)), np.zeros(d // 2)])
        yield np.repeat([5.0, 2.0, 1.0], [d // 3, d // 3, d - 2 * (d // 3)])
        yield np.concatenate([[1e6], rng.random(d - 1)])


def test_contours_miss_no_eigenvalue(monkeypatch):
    """Every spectrum's largest eigenvalues and an orthonormal basis with small residuals, solved without Spark."""
    monkeypatch.setattr(W, "_solved", lambda _, v, circles, blocks: [sum(W.at_node(v.value, c, b, k) for k in range(W.NODES)) for c, b in zip(circles, blocks, strict=True)])

    class Sent:
        def __init__(self, value):
            self.value = value

        def unpersist(self):
            pass

    class Session:
        sparkContext = type("Context", (), {"broadcast": staticmethod(Sent)})

    rng = np.random.default_rng(4)
    for spectrum in spectra():
        d = len(spectrum)
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = (q * spectrum) @ q.T
        v = (v + v.T) / 2
        values, axes = W.eigenpairs(Session, v, 8)
        want = np.sort(np.linalg.eigvalsh(v))[::-1][:8]
        assert len(values) == (want > 8 * d * W.EPS * want[0]).sum() or want[len(values)] < 1e-12 * want[0]
        assert np.abs(values - want[: len(values)]).max() <= 1e-12 * want[0]
        assert np.abs(v @ axes - axes * values).max() <= 1e-12 * want[0]
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() <= 1e-8


def test_inertia_counts():
    rng = np.random.default_rng(6)
    for _ in range(200):
        d = int(rng.integers(1, 30))
        v = rng.standard_normal((d, d))
        v += v.T
        shape, values = W.tridiagonal(v), np.linalg.eigvalsh(v)
        shifts = rng.standard_normal(10) * 3
        assert (W.above(*shape, shifts) == (values[:, None] > shifts).sum(axis=0)).all()
