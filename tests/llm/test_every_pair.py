"""Links of lone pairs in large labels."""

import numpy as np

from vidimus.llm import embedding_dedup as E


def test_lone_pairs_of_a_large_label(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(1_000):  # each of the first thousand has one partner, just within the cosine
        aside = x[k + 1_000] - (x[k + 1_000] @ x[k]) * x[k]
        x[k + 1_000] = 0.932 * x[k] + np.sqrt(1 - 0.932**2) * aside / np.linalg.norm(aside)
    frame = spark.createDataFrame([(k, 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(frame).collect()}
    close = x @ x.T >= E.COSINE
    assert close.sum() == 8_000 + 2_000
    assert got == {k: (int(k < 2_000), k - 1_000 if 1_000 <= k < 2_000 else k, not 1_000 <= k < 2_000) for k in range(8_000)}
