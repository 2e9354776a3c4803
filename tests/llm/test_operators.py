"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vidimus.llm import chat_format, decontaminate, disclosure, embedding_dedup, license_scan, line_dedup, lm_scoring, mixing, ngram_jaccard, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, root string, key string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 6))) for _ in range(4000)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(VOCABULARY, k=n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "y") for i, t, s in rows], DOCS)


def awkward():
    """(doc_id, text, source): nulls, blanks, ties, repeats and a very long text."""
    long = prose(30_000)
    return [(1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, "one two", "a"), (4, "one two", "a"), (None, "one two", "b"), (None, None, None), (5, long, "a"), (6, long, "c"), (7, "Ünï çødé x", "c"), (8, "a" * 50_000, "a")]


def word_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [word_sets(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _, _) in enumerate(rows))


def changed(text, n, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), min(n, len(words))):
        words[at] = rng.choice(VOCABULARY)
    return " ".join(words)


@pytest.mark.parametrize("few", [32, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_jaccard, "FEW", few)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    rng = random.Random(few)
    rows = awkward()
    passage = prose(30, rng)
    for size in (5, 6, 9, 14, 23, 40, 64, 130, 300):
        base = prose(size, rng)
        rows += [(100 + len(rows), changed(base, rng.randint(0, max(1, size // 25)), rng), "s") for _ in range(12)]
        rows += [(100 + len(rows), base + " " + prose(rng.randint(1, max(1, size // 5)), rng), "s") for _ in range(4)]
    rows += [(100 + len(rows), passage + " " + prose(12, rng), "s") for _ in range(30)]
    got = ngram_jaccard.ngram_jaccard(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, 40), dtype=np.uint64)]))
        if len(b):
            assert ngram_jaccard.hamming(ngram_jaccard.sketch(a), ngram_jaccard.sketch(b)) <= len(np.setxor1d(a, b))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                none = np.array([], np.uint64)
                assert np.intersect1d(ngram_jaccard.signature(a, none), ngram_jaccard.signature(b, none)).size


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    rows = [(i, int(i % 2), (base[i % 6] + rng.normal(0, 0.08, 16)).tolist()) for i in range(60)]
    rows += [(100, 1, None), (101, 1, [0.0] * 16), (102, 0, [math.nan] * 16), (103, None, base[0].tolist()), (104, 0, [None, 1.0]), (105, 0, []), (106, 0, rows[0][2]), (107, 1, [1.0, 2.0]), (108, 1, [2.0, 4.0]), (109, 1, [math.inf] + [0.0] * 15)]
    frame = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, label int, embedding array<double>, root int, class int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(frame).collect()}

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = {i: (lab, unit(v)) for i, lab, v in rows}
    near = {i: [j for j, (m, y) in units.items() if j != i and lab is not None and lab == m and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.93] for i, (lab, x) in units.items()}
    for i, links in near.items():
        seen, todo = {i}, list(links)
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo += near[j]
        assert got[i] == (len(links), min(seen), i == min(seen))


def test_mixing(spark):
    rng = random.Random(2)
    rows = awkward() + [(1000 + i, prose(rng.randint(1, 60), rng), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, stopped = {}, 1.5 * sum(sizes.values()), set()
    while True:
        level = (left - sum(2 * sizes[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        stopped |= more
    target = {s: 2 * sizes[s] if s in stopped else level * weight[s] for s in order}
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source]) and r.source_size == sizes[r.source] and (r.size == 0 or r.taken in (0, r.size, 2 * r.size))
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def pii_holds(kind, found):
    only = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 14 <= len(only) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(only))) % 10 == 0
    return kind != "phone" or 10 <= len(only) <= 15


def pii_spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PII) for m in p.finditer(text or "") if pii_holds(kind, m.group()))


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(4)
    parts = ["a@b.co", "x@y.z_@q.r", "a@b.c.d@e.f", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.004", "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "𝒳", "\n", "%", "+", "-", " ", ".", "7"]
    rows = awkward() + [(100 + i, "".join(rng.choices(parts, k=rng.randint(1, 40))), "s") for i in range(300)] + [(900, "a@b.co " * 3000, "s"), (901, "1" * 20_000, "s"), (902, "a" * 20_000 + "@", "s")]
    got = disclosure.find(docs(spark, rows)).collect()
    expected = {(i, t): pii_spans(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        want = expected[r.doc_id, r.text]
        assert [tuple(s) for s in r.base] == want, (r.doc_id, r.text[:200])
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_disclosing_terms_and_sanitised_text(spark):
    rng = random.Random(6)
    rows = [(i, f"{prose(20, rng)} postbox é a{i}@b.co {prose(20, rng)}", "s") for i in range(20)] + [(100 + i, prose(40, rng), "s") for i in range(200)] + [(400, "postbox alone", "s"), (401, None, "s")]
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs(spark, rows)).collect()}
    assert all("<term> é <email>" in clean[i] and "@" not in clean[i] for i in range(20))
    assert clean[400] == "postbox alone" and clean[401] is None
    assert all(clean[i] == t for i, t, _ in rows[20:])


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(k, prose(rng.randint(9, 50), rng)) for k in range(30)] + [(90, None), (91, "too short")]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    rows = awkward() + [(100 + k, f"{prose(50, rng)} {items[k][1].upper()}, {prose(50, rng)}", "s") for k in range(15)] + [(200 + k, prose(200, rng), "s") for k in range(30)]
    rows += [(300 + k, f"{prose(30, rng)} {changed(items[k][1], 1, rng)} {prose(30, rng)}", "s") for k in range(15) if len(items[k][1].split()) >= 30]
    for block in (decontaminate.BLOCK, 100):
        found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs(spark, rows), bench, block).collect()}
        assert found == {(i, i % 100) for i, _, _ in rows if i and (100 <= i < 200 or 300 <= i < 400)}
    left = decontaminate.decontaminate(docs(spark, rows), bench).collect()
    assert Counter(r.doc_id for r in left) == Counter(i for i, _, _ in rows if i is None or i < 100 or 200 <= i < 300)


def test_chat_format(spark):
    call = lambda i, q: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": q}]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [(1, 0, "user", "hi é"), (1, 1, "tool", result("a", "late")), (1, 2, "assistant", call("a", {"query": "x"})), (1, 3, "user", "{broken"), (1, 4, "assistant", call("b", {"limit": 3})), (1, 5, "tool", result("zz", "none")), (2, 0, "tool", result("a", "other conversation")), (None, None, None, None), (3, 0, "user", ""), (3, 0, "user", "")]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, position int, calls string")
    schemas = {"search": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}}
    got = {(r.conv_id, r.position): r for r in chat_format.chat_format(frame, schemas).collect()}
    assert len(got) == len(rows)
    assert [got[1, k].turn for k in range(6)] == [0, 2, 1, 3, 4, 5]
    assert [got[1, k].linked for k in range(6)] == [None, None, True, None, None, False] and got[2, 0].linked is False
    assert (got[1, 1].n_calls, got[1, 1].n_valid, got[1, 1].n_answered) == (1, 1, 1) and (got[1, 4].n_valid, got[1, 4].n_answered) == (0, 0)
    assert got[1, 0].message == '{"content":"hi é","role":"user"}' and got[None, 0].message == '{"content":"","role":null}'


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit"].split()
    rows = awkward() + [(50, "Released under the MIT License. mit  license", "s"), (51, " ".join(mit[:60]).title() + ".", "s"), (52, " ".join(mit[10:40] + ["zzz"] + mit[42:80]), "s"), (53, prose(300), "s"), (54, "GNU General Public License\nApache License", "s")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert (got[50].n_base, got[50].first_word, got[50].last_word, got[50].base_labels) == (2, 3, 5, "mit")
    assert got[51].labels == "mit" and got[51].base_labels == "" and abs(got[51].score - 60 / len(mit)) < 1e-9
    assert got[52].labels == "mit" and abs(got[52].score - 68 / len(mit)) < 1e-9
    assert got[53].labels == "" and got[54].base_labels == "apache,gpl"
    assert (got[1].n_words, got[1].score, got[1].first_word) == (0, 0.0, None)
    automaton = license_scan.Automaton({"x": "a b c a b d", "y": "b c a b c"})
    ids = [automaton.vocabulary[w] for w in b"b c a b d b c a b c".split()]
    license_scan.LONG, long = 1, license_scan.LONG
    assert [(f, n) for f, n, _ in automaton.stretches(ids, 0)] == [(0, 5), (5, 5)]
    license_scan.LONG = long


def held(c):
    return toxicity.crc(c) % 7 == 2


def test_lm_scores(spark):
    rows = awkward() + [(100 + i, prose(30), "s") for i in range(60)]
    for head in (lm_scoring.HEAD, (4, 4)):
        lm_scoring.HEAD, kept = head, lm_scoring.HEAD
        got = lm_scoring.lm_scores(docs(spark, rows), held).collect()
        lm_scoring.HEAD = kept
        count = Counter()
        for i, t, _ in rows:
            if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
                count.update([*(t or "").encode().lower().split(), None])
        n, v = sum(count.values()), len(count)
        want = Counter()
        for i, t, _ in rows:
            words = [*(t or "").encode().lower().split(), None]
            want[i, len(words), sum(count[w] > 0 for w in words), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), 5)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    prose_bits = [r.bits_per_byte for r in got if r.doc_id and r.doc_id >= 100 and r.held_out]
    assert prose_bits and np.mean(prose_bits) < 3.9  # ten letters and a space at random have log2(11) bits at least in the inner positions


def test_toxicity_held_out(spark):
    rng = random.Random(12)
    rows, labels = awkward(), []
    for i in range(900):
        toxic = rng.random() < 0.2
        words = prose(60, rng).split()
        for at in rng.sample(range(60), 5 if toxic else 0):
            words[at] = rng.choice(["idiot", "moron", "zzqu" + rng.choice(["a", "be", "ix"])])
        rows.append((1000 + i, " ".join(words), "s"))
        labels.append((1000 + i, 1, int(toxic)))
    truth = dict((i, t) for i, _, t in labels)
    labels = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (1000, 1, truth[1000])], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels, lambda c: toxicity.crc(c) % 5 != 0).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    fold = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in fold) >= 0.95 * len(fold)
    none = toxicity.toxicity(docs(spark, rows), labels.where("false"), lambda c: toxicity.crc(c) % 5 != 0)
    assert none.count() == len(rows)


def test_empty_tables(spark):
    empty = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for frame in (ngram_jaccard.ngram_jaccard(empty), mixing.mix(empty), disclosure.find(empty), decontaminate.overlaps(empty, bench), decontaminate.decontaminate(empty, bench), line_dedup.line_dedup(empty), license_scan.license_scan(empty), lm_scoring.lm_scores(empty, held), toxicity.toxicity(empty, labels, held), embedding_dedup.embedding_dedup(vectors), chat_format.chat_format(chats)):
        assert frame.count() == 0


def test_base_digest_form(spark):
    got = disclosure.find(docs(spark, [(1, "x a@b.co 1.2.3.4", "s")])).select(disclosure.listed("base")).first()[0]
    assert got == "email:2:8,ip:9:16" and len(hashlib.sha256(got.encode()).hexdigest()) == 64
