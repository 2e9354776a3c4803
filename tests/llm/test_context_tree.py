"""Context-tree weighting against a recursive brute force, as a distribution, and over depths."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np

from .test_operators import docs, prose

from vidimus.llm import lm_scoring as M
from vidimus.llm import toxicity

kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def held(c):
    return toxicity.crc(c) % 7 == 2


class Tree:
    def __init__(self, texts, depth):
        self.depth, self.seen, self.longer, self.memo = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for t in texts:
            for context, prefix, bit in self.steps(t):
                for d in range(depth + 1):
                    c = context[depth - d :]
                    self.seen[c, prefix][bit] += 1
                    if d:
                        self.longer[c[1:], prefix].add(c)

    def steps(self, text):
        raw = b"\0" * self.depth + text.lower() + b"\xff"
        for k in range(self.depth, len(raw)):
            bits = f"{raw[k]:08b}"
            for j in range(8):
                yield raw[k - self.depth : k], bits[:j], int(bits[j])

    def weighted(self, c, prefix):
        if (c, prefix) not in self.memo:
            own = kt(*self.seen[c, prefix])
            self.memo[c, prefix] = own if len(c) == self.depth else np.logaddexp(own, sum(self.weighted(x, prefix) for x in self.longer[c, prefix])) - math.log(2)
        return self.memo[c, prefix]

    def one(self, context, prefix, d=0):
        c = context[self.depth - d :]
        if (c, prefix) not in self.seen:
            return None
        a, b = self.seen[c, prefix]
        own, deeper = (b + 0.5) / (a + b + 1), self.one(context, prefix, d + 1) if d < self.depth else None
        trust = math.exp(kt(a, b) - math.log(2) - self.weighted(c, prefix))
        return own if deeper is None else trust * own + (1 - trust) * deeper

    def score(self, text):
        total = 0.0
        for context, prefix, bit in self.steps(text):
            p = self.one(context, prefix)
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "AT_ONCE", 300)
    rng = random.Random(17)
    rows = [(1, None, "a"), (2, "", "a"), (None, "one two", "b"), (3, "Ünï çødé", "a"), (4, "\0\0 \0", "a"), (4, "\0\0 \0", "a")] + [(100 + i, prose(rng.randint(1, 25), rng), "s") for i in range(40)]
    tree = Tree([(t or "").encode() for i, t, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2], M.DEPTH)
    want = sorted((i or -1, round(tree.score((t or "").encode()), 6)) for i, t, _ in rows)
    for head in (M.HEAD, (3, 30)):
        monkeypatch.setattr(M, "HEAD", head)
        got = M.lm_scores(docs(spark, rows), held).collect()
        assert np.allclose(sorted((r.doc_id or -1, r.score) for r in got), want, atol=1e-4)
    assert any(r.held_out for r in got)


def test_every_context_has_a_distribution():
    codes, _ = M._codes([b"abracadabra " * 50, b"cabbage"])
    each, times = np.unique(codes, return_counts=True)
    levels = M.subtrees(each, times)
    while len(levels) <= M.DEPTH:
        levels.append(levels[-1].above())
    for context in (b"\0\0\0\0\0", b"cadab", b"zzzab", b"qqqqq"):
        start = 0
        for byte in context[::-1]:
            start = start << 8 | byte
        assert math.isclose(np.exp(M.log_probability(np.arange(256) | start << 8, levels)).sum(), 1, rel_tol=1e-9)
    assert np.allclose(M.log_gamma(np.array([0.5, 1.0, 3.5, 40.0])), [math.lgamma(x) for x in (0.5, 1.0, 3.5, 40.0)], atol=1e-8)
