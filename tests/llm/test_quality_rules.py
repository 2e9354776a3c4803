"""Quality rules against plain Python: measures, sketches, fences and the verdict."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vidimus.llm import quality_rules as Q

DOCS = "doc_id long, text string, lang string, source string, n_words string, values int, bucket int, l_ string"


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


def bucket(x):
    e = max(x.bit_length() - 9, 0)
    return e * 256 + (x >> e)


def middle(b):
    e = max(b // 256 - 1, 0)
    return ((b - e * 256) << e) + (1 << e) // 2


def quartile(values, share):
    buckets = sorted(map(bucket, values))
    return middle(buckets[math.ceil(len(buckets) * share / 4) - 1])


def verdicts(rows, least):
    held, groups = [], [defaultdict(list) for _ in range(3)]
    for _, text, lang, source in rows:
        m = measured(text)
        bad = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        x = {k: m[a] * 1000 // m[b] if m[b] else 0 for k, (a, b, *_) in Q.RULES.items()}
        held.append((m, bad, x))
        if not bad:
            for level, key in enumerate([(lang, source), lang, None]):
                groups[level][key].append(x)
    out = []
    for (doc_id, _, lang, source), (m, bad, x) in zip(rows, held, strict=True):
        failed = []
        if not bad:
            group = next((g for g in (groups[0][lang, source], groups[1][lang]) if len(g) >= least), groups[2][None])
            for k, (_, b, spread, both, off) in Q.RULES.items():
                low, high = (quartile([y[k] for y in group], s) for s in (1, 3))
                width, stray = Q.REACH * max(high - low, spread), off / math.sqrt(max(m[b], 1))
                if x[k] > high + width + stray or (both and x[k] < low - width - stray):
                    failed.append(k)
        out.append((doc_id, lang, source, *m.values(), bad, tuple(sorted(failed)), not bad and not failed))
    return Counter(out)


def corpus():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdeé", k=n))
    prose = lambda n, size=5: " ".join(word(max(1, round(rng.gauss(size, 1.5)))) for _ in range(n))
    rows = []
    for i in range(500):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None, ""])
        size = 9 if lang == "de" else 5
        text = "\n".join(prose(rng.randint(1, 40), size) for _ in range(rng.randint(1, 6)))
        kind = i % 20
        if kind == 0:
            text = " | ".join(prose(30, size).split())
        elif kind == 1:
            text = prose(60, 22)
        elif kind == 2:
            text = "\n".join([prose(1, size)] * 30 + [prose(300, size)])
        elif kind == 3:
            text = prose(6, size) + " " + " ".join(["one two three four five six seven"] * 3) + " " + prose(90, size)
        elif kind == 4:
            text = "\n\n".join([text, text])
        rows.append((i, text, lang, source))
    line = "the same line again"
    awkward = [None, "", " \n\t\r\x0b\x0c ", "nine words are too few for this rule here", "a " * 40_000, "𝒳\x1cé\x85z " * 12, f"{line}\n{line} \n{line}\n\n \n", "x" * 100_000, "#*$%&|<> " * 10, prose(50_000)]
    return rows + [(1000 + i, t, "en", "a") for i, t in enumerate(awkward)] + [(None, rows[5][1], "fr", "c"), (7, rows[5][1], "fr", "c"), (7, rows[5][1], "fr", "c")]


def test_equals_plain_python(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS).repartition(5)
    for least in (1, 40, 10_000):
        got = Q.quality_rules(frame, least=least).collect()
        found = Counter((*(tuple(x) if isinstance(x, list) else x for x in r),) for r in got)
        assert found == verdicts(rows, least), least
    assert {k for r in verdicts(rows, 40) for k in r[-2]} >= {"word_length", "symbols", "duplicate_lines"}


def test_sketches_merge_and_bound_the_error(spark):
    rng = random.Random(1)
    values = [int(rng.lognormvariate(9, 4)) for _ in range(4_000)] + [0, 1, 511, 512, 2**40]
    one = spark.createDataFrame([(i % 7, x) for i, x in enumerate(values)], "part int, x long")
    whole = Q.sketches(one.withColumn("k", F.lit(0)), ["k"])
    merged = Q.sketches(one, ["part"]).groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("k", F.lit(0)).select("k", "bucket", "n")
    assert sorted(whole.collect()) == sorted(merged.collect())
    found = Q.quartiles(merged, ["k"]).first()
    values.sort()
    assert found.total == len(values)
    for got, share in ((found.low, 1), (found.high, 3)):
        exact = values[math.ceil(len(values) * share / 4) - 1]
        assert abs(got - exact) <= exact / 512 + 1


def test_empty_table(spark):
    assert Q.quality_rules(spark.createDataFrame([], DOCS)).collect() == []


def test_a_source_full_of_symbols_is_measured_by_its_own_fence(spark):
    rng = random.Random(9)
    code = lambda: " ".join(rng.choice(["$x", "a<b", "p->q", "*r", "if", "then", "&y"]) + rng.choice("abcdefghijklm") for _ in range(200))
    prose = lambda: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(200))
    rows = [(i, code(), "en", "code") for i in range(300)] + [(1000 + i, prose(), "en", "news") for i in range(300)] + [(5000, code(), "en", "news")]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)
    assert [r.doc_id for r in Q.quality_rules(frame).where("not kept").collect()] == [5000]
