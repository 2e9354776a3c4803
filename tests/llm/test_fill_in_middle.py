"""The fill-in-middle transformation against plain Python, on awkward texts and forms."""

import hashlib
import random
import re

import pytest

from vidimus.llm.fill_in_middle import SENTINELS, fill_in_middle

DOCS = "doc_id long, text string, form string, n int, h1 string, output string"


def expected(doc_id, text, rate=100, suffix_first=50, sentinels=SENTINELS, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text, text
    p, s, m = sentinels
    if h[3] % 100 < suffix_first:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle, text
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle, text


def rows():
    rng = random.Random(2)
    parts = ["a", "\n", "\n\n", "é", "𝒳", "<", ">", "P>", "<S", "\r", "\x0b", "\x00", " ", "the end", "<M", "<P>"]
    made = [(i, "".join(rng.choices(parts[:-1] if i % 9 else parts, k=rng.randint(0, 14)))) for i in range(600)]
    long = "\n".join("word " * rng.randint(0, 40) for _ in range(20_000))
    return [*made, (None, "null id\nof two"), (None, None), (7, "\n"), (7, "\n"), (7, None), (8, ""), (9, long), (10, "x" * 300_000), (-3, "a\nb\nc"), (2**62, "a\nb\n")]


@pytest.mark.parametrize("options", [{}, {"rate": 60, "suffix_first": 20, "seed": 11}, {"sentinels": ("[[p]]", "[[s]]", "[[m]]")}])
def test_equals_plain_python(spark, options):
    made = rows()
    got = fill_in_middle(spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in made], DOCS), **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode(), bytes(r.restored).decode()) for r in got), key=key)
    assert found == sorted((expected(i, t, **options) for i, t in made), key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_bad_sentinels(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fill_in_middle(empty).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fill_in_middle(empty, sentinels=bad)
