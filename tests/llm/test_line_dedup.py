"""Line and sentence dedup against brute force, with passages that begin and end inside lines."""

import random
import re
from collections import Counter

import pytest

from .test_operators import awkward, docs, prose

from vidimus.llm import line_dedup as L


def cut(text):
    """(begin, stop, words) of the units that have a word, character by character."""
    out, begin, k = [], 0, 0
    while k < len(text):
        end = text[k] == "\n" or k > 0 and text[k] in " \t\n\v\f\r" and text[k - 1] in ".!?"
        k += 1
        if end or k == len(text):
            words = tuple(re.findall(rb"[^\x20\x09-\x0D]+", text[begin:k].encode().lower()))
            if words:
                out.append((begin, k, words))
            begin = k
    return out


def brute(rows, least, passage):
    each = [cut(t or "") for _, t, _ in rows]
    times = Counter(w for u in each for *_, w in u)
    seen, want = set(), Counter()
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        units, again, later = each[k], [], []
        for n, (_, _, w) in enumerate(units):
            if times[w] > 1:
                again.append(n)
            if w in seen:
                later.append(n)
            seen.add(w)
        grouped = lambda at: [[n for n in at if n - at.index(n) == d] for d in sorted({n - at.index(n) for n in at})]
        size = lambda run, units=units: sum(len(units[n][2]) for n in run)
        lengths = [size(r) for r in grouped(again)]
        gone = [r for r in grouped(later) if size(r) >= least]
        spans = tuple((units[r[0]][0], units[r[-1]][1]) for r in gone)
        text, at = "", 0
        for b, e in spans:
            text, at = text + (rows[k][1] or "")[at:b], e
        want[rows[k][0], len(units), len(again), max(lengths, default=0), sum(n >= passage for n in lengths), sum(map(len, gone)), spans, text + (rows[k][1] or "")[at:]] += 1
    return want


@pytest.mark.parametrize("hot", [1_000, 3])
def test_lines_and_sentences_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(L, "HOT", hot)
    rng = random.Random(hot)
    sentences = [prose(rng.randint(1, 14), rng).capitalize() + rng.choice([".", "!", "?!", "...", ""]) for _ in range(25)]
    joined = lambda n: "".join(rng.choice(sentences) + rng.choice([" ", "\n", "\n\n", "  ", "\t", " é. "]) for _ in range(n))
    passage = " ".join(f"{prose(11, rng)}." for _ in range(6))
    rows = [r for r in awkward() if (r[0], r[1]) not in ((4, "one two"),)]
    rows += [(100 + i, joined(rng.randint(0, 12)), "s") for i in range(60)]
    rows += [(300 + i, f"{prose(30, rng)} {passage} {prose(9, rng)}\n{prose(12, rng)}", "s") for i in range(8)]
    rows += [(400 + i, prose(40, rng), "s") for i in range(10)]
    got = L.line_dedup(docs(spark, rows), texts=True).collect()
    assert Counter((r.doc_id, r.n_units, r.n_repeated, r.longest_run, r.n_passages, r.n_removed, tuple(map(tuple, r.removed)), r.text) for r in got) == brute(rows, L.LEAST_WORDS, L.PASSAGE_WORDS)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[300 + i].n_passages == 1 and by_id[300 + i].longest_run >= 55 for i in range(8))
    assert all(by_id[400 + i].n_repeated == 0 for i in range(10))


def test_ties_do_not_depend_on_the_layout(spark):
    rows = [(7, f"{'a b c d e f g h i j. '}{x}", "s") for x in ("alpha", "beta", "gamma")] * 2
    seen = [Counter((r.doc_id, r.n_removed, r.text) for r in L.line_dedup(docs(spark, order).repartition(n), texts=True).collect()) for order, n in ((rows, 1), (rows[::-1], 3))]
    assert seen[0] == seen[1] and sum(n for (_, gone, _), n in seen[0].items() if gone) == 5


def test_empty_table(spark):
    assert L.line_dedup(docs(spark, [])).count() == 0
