"""Licence scans of random texts against brute force: words, phrases, matching statistics, chains."""

import random
import re

from .test_operators import docs, prose

from vidimus.llm import license_scan as S

WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def jumbled(rng):
    """Pieces of templates, phrases and other words, with some words swapped."""
    templates, out = [t.split() for t in S.TEMPLATES.values()], []
    for _ in range(rng.randint(0, 14)):
        t = rng.choice(templates)
        at, kind = rng.randrange(len(t)), rng.random()
        out += t[at : at + rng.randint(1, 40)] if kind < 0.6 else rng.choice([*S.PHRASES, "General Public", "license mit license"]).split() if kind < 0.8 else prose(rng.randint(1, 70), rng).split()
    return [rng.choice(["the", "zz"]) if rng.random() < 0.03 else w for w in out]


def test_words_and_phrases(spark):
    rng = random.Random(41)
    rows = [(k, rng.choice([" ", "-", "\n", ", "]).join(w.title() if rng.random() < 0.2 else w for w in jumbled(rng)), "s") for k in range(150)] + [(900, "é mit-license MIT\tLICENSE x\x7fy", "s")]
    got = {r.doc_id: r for r in S.license_scan(docs(spark, rows)).collect()}
    for i, text, _ in rows:
        words = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
        places = [(k, label) for k in range(len(words)) for p, label in S.PHRASES.items() if words[k : k + len(p.split())] == p.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None)), text
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")} and 0 <= r.score <= 1


def test_stretches_and_chains():
    rng = random.Random(42)
    automaton = S.Automaton(S.TEMPLATES)
    templates = [[automaton.vocabulary[w] for w in t.encode().split()] for t in S.TEMPLATES.values()]
    ends = {}
    for t, tokens in enumerate(templates):
        for b in range(len(tokens)):
            for e in range(b + 1, len(tokens) + 1):
                ends.setdefault(tuple(tokens[b:e]), []).append((t, b))
    for _ in range(40):
        ids = [k for k in (automaton.vocabulary.get(w.encode(), -1) for w in jumbled(rng)) if k >= 0]
        reach = [max((n for n in range(1, len(ids) - b + 1) if tuple(ids[b : b + n]) in ends), default=0) for b in range(len(ids))]
        want = [(b, n) for b, n in enumerate(reach) if n >= S.LONG and (b == 0 or reach[b - 1] <= n)]
        found = automaton.stretches(ids, 0)
        assert [(b, n) for b, n, _ in found] == want
        best = {}
        parts = sorted((t, b, n, at) for b, n in want for t, at in ends[tuple(ids[b : b + n])])
        scores = []
        for k, (t, b, n, at) in enumerate(parts):
            score = n
            for m in range(k):
                u, c, o, a = parts[m]
                if u == t and c < b and a < at and b - c - o <= S.GAP:
                    score = max(score, scores[m] + n - max(0, c + o - b, a + o - at))
            scores.append(score)
            best[t] = max(best.get(t, 0), score)
        assert {t: c for t, (c, _, _) in automaton.coverage(found).items()} == best


def test_no_stretch_is_forgotten_in_between(monkeypatch):
    """Far more stretches than any fixed number may lie between two that belong together: "m m" fits at 150 places, none of them between the two."""
    monkeypatch.setattr(S, "LONG", 2)
    first, last = " ".join(f"a{k}" for k in range(40)), " ".join(f"c{k}" for k in range(40))
    automaton = S.Automaton({"x": "m " * 151 + f"y {first} {last}"})
    ids = lambda text: [automaton.vocabulary[w] for w in text.encode().split()]
    found = [*automaton.stretches(ids(first), 0), *automaton.stretches(ids("m m"), 45), *automaton.stretches(ids(last), 50)]
    assert len(found) == 3 and automaton.coverage(found)[0] == (80, 0, 90)
