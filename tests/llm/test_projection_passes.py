"""Sorted projection passes alone: what share of the links of a large label they meet, and tiles of the exact check."""

import numpy as np

from vidimus.llm import embedding_dedup as E


def planted(rng, n, groups, least):
    """n unit vectors of 64 dimensions, the last 2 * groups of them at cosines of `least` to nearly 1 to one of the first."""
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(2 * groups):
        aside = x[n - 1 - k] - (x[n - 1 - k] @ x[k % groups]) * x[k % groups]
        c = rng.uniform(least, 0.999)
        x[n - 1 - k] = c * x[k % groups] + np.sqrt(1 - c * c) * aside / np.linalg.norm(aside)
    return x


def test_recall_of_the_passes(spark):
    x = planted(np.random.default_rng(6), 12_000, 2_000, 0.935)
    close = np.triu(x @ x.T >= E.COSINE, 1)
    frame = spark.createDataFrame([(k, 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r for r in E.embedding_dedup(frame, exact=False).collect()}
    links = sum(r.n_links for r in got.values()) / 2
    assert 0.97 * close.sum() <= links <= close.sum()
    a, b = np.nonzero(close)
    joined = np.mean([got[i].component_id == got[j].component_id for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert joined >= 0.98
    print("passes alone:", links / close.sum(), joined)
    whole = {r.vec_id: r.n_links for r in E.embedding_dedup(frame).collect()}
    both = close | close.T
    assert whole == {k: int(both[k].sum()) for k in range(len(x))}


def test_tiles_meet_every_pair(spark, monkeypatch):
    monkeypatch.setattr(E, "PASSES", 1)
    monkeypatch.setattr(E.checked, "__defaults__", (E.COSINE, 8 * 64 * 50))
    monkeypatch.setattr(E.window_pairs, "__defaults__", (E.COSINE, 1, 1, False))
    x = planted(np.random.default_rng(7), 600, 90, 0.9)
    frame = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(np.repeat(x, 2, axis=0))], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_dedup(frame).collect()}
    close = x @ x.T >= E.COSINE
    least = np.arange(600)
    for _ in range(600):
        now = np.where(close, least[None, :], 600).min(axis=1)
        if (now == least).all():
            break
        least = now
    assert got == {2 * k + label: (int(close[k].sum()) - 1, 2 * int(least[k]) + label) for k in range(600) for label in (0, 1)}
