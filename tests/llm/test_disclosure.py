"""Disclosing terms against a brute-force count over the corpus."""

import math
import random
import re
from collections import Counter, defaultdict

from vidimus.llm import disclosure as D

from .test_operators import docs, pii_spans

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}")


def brute(rows, least, threshold):
    """Spans of each row: the base ones and the terms that disclose a kind it holds."""
    base = [pii_spans(t) for _, t, _ in rows]
    n_kind, n_term, n_both = Counter(), Counter(), Counter()
    held = []
    for (_, text, _), spans in zip(rows, base, strict=True):
        text, kinds = text or "", {s[3] for s in spans}
        rest, at = [], 0
        for b, _, e, _ in spans:
            if b >= at:
                rest += [text[at:b], " "]
            else:
                rest.append("")
            at = max(at, e)
        rest = "".join([*rest, text[at:]])
        here = {t.lower() for t in TERM.findall(rest)}
        held.append((kinds, here))
        n_kind.update(kinds)
        n_term.update({t.lower() for t in TERM.findall(text)})
        n_both.update((t, k) for t in here for k in kinds)
    strong = defaultdict(set)
    for (t, k), n in n_both.items():
        own = math.log2(len(rows) / n_kind[k])
        if n >= least and own > 0 and math.log2(n * len(rows) / (n_term[t] * n_kind[k])) / own >= threshold:
            strong[k].add(t)
    out = []
    for (i, text, _), spans, (kinds, here) in zip(rows, base, held, strict=True):
        wanted = {t for k in kinds for t in strong[k]} & here
        more = [(m.start(), 4, m.end(), "term") for m in TERM.finditer(text or "") if m.group().lower() in wanted and not any(b < m.end() and m.start() < e for b, _, e, _ in spans)]
        out.append((i, tuple(sorted(spans + more))))
    return Counter(out)


def test_terms_equal_brute_force(spark):
    rng = random.Random(19)
    kinds = {"mail": "u{}@b.co", "host": "10.1.{}.7", "call": "+1 555 {:03d} 4567", "the": "x"}
    words = [f"w{chr(97 + k)}rd" for k in range(20)] + ["é1", "ÀÉÎ", "ab"]
    rows = [(0, None, "s"), (1, "", "s")]
    for k in range(400):
        parts = rng.choices(words, k=rng.randint(0, 15))
        for word, form in kinds.items():
            if rng.random() < 0.1:
                parts += [rng.choice([word, word.upper(), word.title()]), form.format(rng.randint(0, 250))]
            if rng.random() < 0.02:
                parts += [word] if word != "call" else []
        rng.shuffle(parts)
        rows.append((10 + k, rng.choice([" ", ", ", "\n"]).join(parts), "s"))
    rows.append(rows[-1])
    want = brute(rows, D.LEAST_DOCUMENTS, D.DISCLOSURE)
    assert sum(s[3] == "term" for _, spans in want for s in spans) > 20
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in D.find(docs(spark, rows)).collect())
    assert got == want
