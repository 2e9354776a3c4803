"""Fill-in-middle transformation as a pyarrow.compute pipeline over Arrow batches.

A batch of texts is split into list arrays of line units, flattened with the index of each unit's text, numbered within its
text, filtered by role (prefix, middle, suffix), rebuilt into lists and joined into the pieces. No text is taken apart in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, portions, texts_in_batches

#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percent of the texts that are transformed, and of those the percent that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"


def draws(c: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit draws of an id, the same at every run; a null id draws as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _remainder(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """The lines of all texts with their line ends: (line, index of its text, ordinal in its text), and the number of lines of each text."""
    lists = pc.split_pattern(texts, "\n")
    values, parents, lengths = pc.list_flatten(lists), pc.list_parent_indices(lists), pc.list_value_length(lists)
    starts = pa.array(np.cumsum(lengths.to_numpy()) - lengths.to_numpy())
    ordinals = pc.subtract(pa.array(np.arange(len(values))), pc.take(starts, parents))
    last = pc.equal(ordinals, pc.subtract(pc.take(lengths, parents), 1))
    # What follows the last line end has none of its own, and is no unit if it is empty.
    empty = pc.and_(last, pc.equal(pc.binary_length(values), 0))
    ends = pc.if_else(last, pa.scalar("", values.type), pa.scalar("\n", values.type))
    there = pc.invert(empty)
    lines = pc.filter(pc.binary_join_element_wise(values, ends, pa.scalar("", values.type)), there)
    parents, ordinals = pc.filter(parents, there), pc.filter(ordinals, there)
    counts = pc.subtract(lengths, pc.cast(pc.filter(empty, last), lengths.type))
    return lines, parents, ordinals, counts


def piece(lines: pa.Array, role: pa.Array, counts: pa.Array) -> pa.Array:
    """The lines with a role, joined for each text; counts: how many each text has."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts.to_numpy())]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(lines, role)), pa.scalar("", lines.type))


def _after(text: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before the first mark and after it."""
    halves = pc.split_pattern(text, mark, max_splits=1)
    return pc.list_element(halves, 0), pc.list_element(halves, 1)


def restore(output: pa.Array, form: pa.Array, sentinels: tuple[str, str, str] = SENTINELS) -> pa.Array:
    """The texts, rebuilt from the outputs and their forms alone."""
    prefix_mark, suffix_mark, middle_mark = sentinels
    none = pa.scalar("", output.type)
    index = np.arange(len(output))
    rebuilt, places = [], []
    for kind in ("plain", "psm", "spm"):
        chosen = pc.equal(form, kind)
        some = pc.filter(output, chosen)
        places.append(index[chosen.to_numpy(zero_copy_only=False)])
        if kind != "plain":
            _, rest = _after(some, prefix_mark if kind == "psm" else suffix_mark)
            first, rest = _after(rest, suffix_mark if kind == "psm" else prefix_mark)
            second, middle = _after(rest, middle_mark)
            prefix, suffix = (first, second) if kind == "psm" else (second, first)
            some = pc.binary_join_element_wise(prefix, middle, suffix, none)
        rebuilt.append(some)
    order = np.empty(len(output), np.int64)
    order[np.concatenate(places)] = index
    return pc.take(pa.concat_arrays(rebuilt), pa.array(order))


def transform(ids: pa.Array, texts: pa.Array, h: list[pa.Array], rate: int, suffix_first: int, sentinels: tuple[str, str, str]) -> pa.RecordBatch:
    lines, parents, ordinals, counts = units(texts)
    places = pc.add(counts, 1)
    one, two = _remainder(h[0], places), _remainder(h[1], places)
    from_, to = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    before, upto = pc.less(ordinals, pc.take(from_, parents)), pc.less(ordinals, pc.take(to, parents))
    prefix = piece(lines, before, from_)
    middle = piece(lines, pc.and_not(upto, before), pc.subtract(to, from_))
    suffix = piece(lines, pc.invert(upto), pc.subtract(counts, to))
    marked = pc.equal(pc.binary_length(texts), 0)
    for mark in sentinels:
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    plain = pc.or_(marked, pc.greater_equal(_remainder(h[2], 100), rate))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(_remainder(h[3], 100), suffix_first), "spm", "psm"))
    p, s, m = (pa.scalar(mark, texts.type) for mark in sentinels)
    none = pa.scalar("", texts.type)
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
    void = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, void, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    restored = restore(output, form, sentinels)
    return pa.RecordBatch.from_arrays([ids, pc.cast(counts, pa.int64()), form, *sizes, *(pc.cast(x, pa.binary()) for x in (output, restored))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])


def fill_in_middle(documents: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored), one row per row of documents; the texts as UTF-8 bytes.

    A text is cut at two of the places before, between and after its n lines; equal places leave the middle empty. Texts that
    are null, empty or hold a sentinel stay as they are (form plain), as do those beyond rate. restored is rebuilt from output
    and form alone and equals the text. Lengths are code points, null for plain. A line ends at its line feed; what follows the
    last one is a line if it is not empty. Rows that share a doc_id are cut by the same draws, null ids too. Repeated rows are
    each answered. Only doc_id and text are read, so extra columns do no harm. An empty table gives an empty result. Narrow:
    texts are neither shuffled nor gathered, and a portion of a batch holds a few MB, or one longer text.
    """
    if any(a[i:] == b[: len(a) - i] for a in sentinels for b in sentinels for i in range(1, len(a))) or any(a in b for i, a in enumerate(sentinels) for j, b in enumerate(sentinels) if i != j) or not all(sentinels):
        raise ValueError("sentinels must not be empty, contain or overlap each other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start, stop in portions(pc.binary_length(texts).to_pylist()):
                part = batch.slice(start, stop - start)
                yield transform(part.column(0), pc.cast(part.column(1), pa.large_string()), part.columns[2:], rate, suffix_first, sentinels)

    rows = texts_in_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of("text").alias("text"), *draws(F.col("doc_id").cast("long"), seed))
    return rows.mapInArrow(run, OUT)
