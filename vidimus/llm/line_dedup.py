"""Substring dedup by hashing lines and sentences.

A text is cut into units at line ends and at sentence ends. Units are normalised (A-Z lower-cased, white space collapsed)
and digested; digests are grouped over the corpus and the occurrence that ranks first stays. Neighbouring units that repeat
are joined to runs, so that a passage which begins or ends inside a line is met in its whole sentences. Spans refer to the
original text, in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, texts_of, written

#: Runs of later occurrences with fewer words stay.
LEAST_WORDS = 8
#: Words of a run of repeated units that count as a passage: one of 50 words, less the sentences that it cuts at its ends.
PASSAGE_WORDS = 36
#: A digest that makes up more than one in so many units is met by broadcast (so many rows at most), the others by hash.
SHARES = 1 << 17
#: No digest is broadcast for fewer units than that.
HOT = 1_000

#: A unit ends with its line, or with the white space after a run of these marks.
END = re.compile(rb"\n|[.!?]+[\x20\x09-\x0D]")
MARK = "struct<at:int,begin:long,stop:long,words:int,later:boolean>"


def units_of(text: bytes) -> Iterator[tuple[int, int, list[bytes]]]:
    """(begin, stop, words) in bytes for each unit that has a word; the units tile the text."""
    at = 0
    for stop in [*(m.end() for m in END.finditer(text)), len(text)]:
        words = text[at:stop].lower().split()
        if words:
            yield at, stop, words
        at = stop


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text, numbered, with its units' digests, places in code points and numbers of words."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in portions(map(len, texts)):
            columns: tuple[list, ...] = ([], [], [], [], [])
            for text in texts[i:j]:
                begins, stops, words = zip(*u, strict=True) if (u := list(units_of(text))) else ((), (), ())
                if not text.isascii():
                    ends = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    begins, stops = ends[list(begins)], ends[list(stops)]
                for column, value in zip(columns, (xxhash.xxh3_64_intdigest(text) - (1 << 63), [xxhash.xxh3_128_digest(b" ".join(w)) for w in words], begins, stops, list(map(len, words))), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), *map(pa.array, columns, kinds), batch.column(1).slice(i, j - i)], names=["row_", "doc_id", "whole", "digests", "begins", "stops", "words", "text"])
            row += j - i


def runs(at: list[int], words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, words) of the runs of consecutive numbers in at, as places in at."""
    first = 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] != at[k - 1] + 1:
            yield first, k - 1, sum(words[first:k])
            first = k


def _decided(least: int, passage: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decide(marks: list[dict] | None) -> tuple[int, int, int, list[dict]]:
        """Words of the longest run, number of passages, removed units, removed spans."""
        marks = sorted(marks or (), key=lambda m: m["at"])
        sizes = [n for *_, n in runs([m["at"] for m in marks], [m["words"] for m in marks])]
        later = [m for m in marks if m["later"]]
        gone = [(a, b) for a, b, n in runs([m["at"] for m in later], [m["words"] for m in later]) if n >= least]
        return max(sizes, default=0), sum(n >= passage for n in sizes), sum(b - a + 1 for a, b in gone), [{"begin": later[a]["begin"], "stop": later[b]["stop"]} for a, b in gone]

    def without(text: bytes, removed: list[dict]) -> str:
        whole, kept, at = text.decode("utf-8", "replace"), [], 0
        for span in removed:
            kept.append(whole[at : span["begin"]])
            at = span["stop"]
        return "".join([*kept, whole[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])))
        for batch in batches:
            marks = batch.column(2).to_pylist()
            rows = [decide(m) for m in marks]
            columns = [batch.column(0), batch.column(1), pa.array([len(m or ()) for m in marks], pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
            if texts:
                columns.append(pa.array([without(t, r[3]) for t, r in zip(batch.column(3).to_pylist(), rows, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_units", "n_repeated", "longest_run", "n_passages", "n_removed", "removed", "text"][: len(columns)])

    return run


def line_dedup(documents: DataFrame, least: int = LEAST_WORDS, passage: int = PASSAGE_WORDS, texts: bool = False) -> DataFrame:
    """(doc_id, n_units, n_repeated, longest_run, n_passages, n_removed, removed[, text]), one row per row of documents.

    n_repeated counts the units of the text that stand at another place too, the kept occurrence included; longest_run is the
    number of words in its longest run of such units, n_passages how many runs have at least `passage` words. Of equal units
    the one with the least (doc_id, text, place) stays, null ids last; a run of later ones goes if it has `least` words or
    more. removed lists (begin, stop) in code points, text (if asked for) is what stays. Null, empty and blank texts have no
    unit. A repeated row loses what its first copy keeps. Only doc_id and text are read. An empty table gives an empty result.
    """
    schema = "row_ long, doc_id long, whole long, digests array<binary>, begins array<long>, stops array<long>, words array<int>, text binary"
    split = texts_of(documents).mapInArrow(_split, schema)
    split = written(split if texts else split.drop("text"))
    each = split.select("row_", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank"), "whole", F.posexplode(F.arrays_zip("digests", "begins", "stops", "words")).alias("at", "u"))
    units = each.select(F.col("u.digests").alias("digest"), F.struct("rank", "whole", "row_", "at").alias("place"), F.col("u.begins").alias("begin"), F.col("u.stops").alias("stop"), F.col("u.words").alias("words"))
    again = written(units.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"))
    many = max(HOT, (split.agg(F.sum(F.size("digests"))).first()[0] or 0) // SHARES)
    hot, others = F.broadcast(again.where(F.col("n") > many)), again.where(F.col("n") <= many)
    met = units.join(hot.select("digest", "first"), "digest").union(units.join(hot.select("digest"), "digest", "left_anti").join(others.select("digest", "first"), "digest"))
    marks = met.groupBy("place.row_").agg(F.collect_list(F.struct("place.at", "begin", "stop", "words", (F.col("place") != F.col("first")).alias("later"))).cast(f"array<{MARK}>").alias("marks"))
    rows = split.select("row_", "doc_id", F.size("digests").cast("long").alias("n_units"), *(["text"] if texts else [])).join(marks, "row_", "left").drop("row_")
    rows = rows.select("doc_id", "n_units", "marks", *(["text"] if texts else []))
    out = "doc_id long, n_units long, n_repeated long, longest_run long, n_passages long, n_removed long, removed array<struct<begin:long,stop:long>>"
    return rows.mapInArrow(_decided(least, passage, texts), f"{out}, text string" if texts else out)
