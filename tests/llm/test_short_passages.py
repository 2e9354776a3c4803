"""Benchmark items of few tokens, with substitutions at every place."""

import random
from collections import Counter
from itertools import combinations

from .test_operators import docs, prose

from vidimus.llm import decontaminate as D


def test_substitutions_in_short_items(spark):
    rng = random.Random(21)
    sizes = [1, 2, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20, 24, 30]
    items = {n: [f"q{n}t{k}" for k in range(n)] for n in sizes}
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    rows, want = [], []

    def add(words, item):
        rows.append((len(rows), f"{prose(20, rng)} {' '.join(words)} {prose(20, rng)}", "s"))
        want.extend([(rows[-1][0], item)] if item else [])

    for n, t in items.items():
        swapped = lambda gone, t=t: ["other" if k in gone else w for k, w in enumerate(t)]
        most = 0 if n < 8 else n // 5
        add(t, n)
        for at in range(n):
            add(swapped({at}), n if most else None)
        pairs = list(combinations(range(n), 2))
        for gone in rng.sample(pairs, min(len(pairs), 40)) if most >= 2 else []:
            add(swapped(set(gone)), n)
        if most:
            step = (n + most) // (most + 1)
            add(swapped(set(range(step - 1, n, step)[:most])), n)
        if 8 <= n <= 15:
            add(swapped(set(range(1, n, 2))), None)
    for block in (D.BLOCK, 40):
        found = D.overlaps(docs(spark, rows), bench, block).collect()
        assert Counter((r.doc_id, r.item_id) for r in found) == Counter(want)
        assert all(20 <= r.first_token and r.first_token + r.n_tokens <= 20 + r.n_item and r.n_matching <= r.n_tokens for r in found)


def test_recall_with_up_to_a_fifth_substituted(spark):
    """Passages of 9 to 50 words; every tenth text holds none."""
    rng = random.Random(22)
    items = [(k, prose(9 + k % 42, rng).split()) for k in range(126)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(None, prose(20, rng))], "item_id long, text string")
    rows, want = [], set()
    for share in (0.05, 0.1, 0.2):
        for k, words in items:
            gone = set(rng.sample(range(len(words)), int(share * len(words))))
            rows.append((len(rows), f"{prose(rng.randint(0, 60), rng)} {' '.join('other' if n in gone else w for n, w in enumerate(words))} {prose(rng.randint(0, 60), rng)}", "s"))
            want.add((rows[-1][0], k))
    rows += [(5_000 + k, prose(300, rng), "s") for k in range(300)]
    for block in (D.BLOCK, 40):
        found = {(r.doc_id, r.item_id) for r in D.overlaps(docs(spark, rows), bench, block).collect()}
        assert found == want


def test_null_and_repeated_items(spark):
    rng = random.Random(23)
    passage = prose(20, rng)
    bench = spark.createDataFrame([(None, passage), (4, passage.upper()), (4, passage), (5, None), (6, " ,;")], "item_id long, text string")
    rows = [(1, f"{prose(5, rng)} {passage}", "s"), (None, passage, "s"), (2, prose(50, rng), "s"), (3, None, "s")]
    for block in (D.BLOCK, 4):
        got = Counter((r.doc_id, r.item_id) for r in D.overlaps(docs(spark, rows), bench, block).collect())
        assert got == Counter({(1, None): 1, (1, 4): 2, (None, None): 1, (None, 4): 2})
