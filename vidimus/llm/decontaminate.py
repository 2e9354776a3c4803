"""Benchmark decontamination by spaced seeds and short clean runs.

A mask of ones and zeros chooses positions of a token window; two windows whose chosen tokens agree share a hash even if
tokens at the other positions were substituted. Hashes of all masks over the benchmark are looked up for every position of
every training text. A hit fixes how passage and text lie against each other; along that diagonal matching tokens count 1
and substituted ones -2, and the best stretch decides. A diagonal also counts if four fifths of the item's tokens match, so
that short items tolerate substitutions; runs without a gap are looked up so short that no such diagonal can be missed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, fresh, mixed, portions, small, texts_in_batches, texts_of, word_hashes, written

#: Fixed masks: 1 takes part in the hash. Runs without a gap join them, as long as clean_run() says.
MASKS = ("1101100101011", "1110010110111", "101110011101011")
#: A stretch of this score is an overlap; items shorter than SHORTEST must match whole, others to four fifths at least.
LEAST = 13
SHORTEST = 8
MISS = -2
#: Seed hits, and tokens of diagonals, that are held at once.
CHUNK = 500_000
#: Benchmark tokens up to which the benchmark is broadcast; a larger one is joined by hash.
BLOCK = 2_000_000
#: The bitmap of seeds that goes before that join has 2 ** FILTER bits.
FILTER = 28

U = np.uint64
_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def tokens(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(_CLEAN).split()


def spaced(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash at each position at which the mask fits."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), U)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = out * U(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)


def least_matching(size: int) -> int:
    """Matching tokens on one diagonal that make an overlap with an item of that size, wherever they stand."""
    return size if size < SHORTEST else -(-4 * size // 5)


def clean_run(size: int) -> int:
    """Some run of so many matching tokens is left when an item has as many substitutions as it tolerates, however they are spread."""
    misses = size - least_matching(size)
    return -(-(size - misses) // (misses + 1))


def masks_of(size: int) -> list[str]:
    """The seeds of an item of that size: its clean run, and the masks that fit."""
    return ["1" * clean_run(size), *(m for m in MASKS if size >= max(SHORTEST, len(m)))]


class Items:
    """Benchmark items: their token hashes end to end."""

    def __init__(self, each: list[np.ndarray]) -> None:
        self.sizes = np.array([len(h) for h in each], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.concatenate([np.array([], U), *each])
        self.needed = np.array([least_matching(n) for n in self.sizes.tolist()], np.int64)

    def judged(self, rows: np.ndarray, h: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, first token, tokens, matching tokens, tokens of the item) for each diagonal that holds an overlap.

        h: the tokens of the texts end to end; rows: diagonals as (text, item, place of the item's first token in the text).
        """
        sizes_of = np.array(lengths, np.int64)
        begins = np.cumsum(sizes_of) - sizes_of
        for i, j in portions(self.sizes[rows[:, 1]].tolist(), CHUNK):
            part = rows[i:j]
            if not len(part):
                continue
            n = self.sizes[part[:, 1]]
            first = np.cumsum(n) - n
            offset = np.arange(n.sum()) - np.repeat(first, n)
            at = np.repeat(part[:, 2], n) + offset
            within = (at >= 0) & (at < np.repeat(sizes_of[part[:, 0]], n))
            theirs = h[np.where(within, at + np.repeat(begins[part[:, 0]], n), 0)]
            equal = within & (theirs == self.hashes[np.repeat(self.starts[part[:, 1]], n) + offset])
            counts = np.add.reduceat(equal, first, dtype=np.int64)
            for k in np.flatnonzero(counts >= np.minimum(np.minimum(LEAST, n), self.needed[part[:, 1]])):
                text, item, d = part[k].tolist()
                size = int(n[k])
                low, high = max(0, -d), min(size, int(sizes_of[text]) - d)
                same = equal[first[k] + low : first[k] + high]
                sums = np.concatenate([[0], np.cumsum(np.where(same, 1, MISS))])
                gains = sums - np.minimum.accumulate(sums)
                end = int(gains.argmax())
                begin = int(np.flatnonzero(sums[: end + 1] == sums[: end + 1].min())[-1])
                if gains[end] < min(LEAST, size):
                    if counts[k] < self.needed[item]:
                        continue
                    matching = np.flatnonzero(same)
                    begin, end = int(matching[0]), int(matching[-1]) + 1
                yield text, item, d + low + begin, end - begin, int(same[begin:end].sum()), size


class Passages(Items):
    """Items with their sorted seed hashes and the places of these."""

    def __init__(self, each: list[np.ndarray]) -> None:
        super().__init__(each)
        self.owner = np.repeat(np.arange(len(each)), self.sizes)
        of_mask: dict[str, list[np.ndarray]] = {}
        for start, size in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            for mask in masks_of(size):
                of_mask.setdefault(mask, []).append(np.arange(size - len(mask) + 1) + start)
        self.seeds = []
        for mask, places in of_mask.items():
            where = np.concatenate(places)
            seeds = spaced(self.hashes, mask)[where]
            order = np.argsort(seeds, kind="stable")
            self.seeds.append((mask, seeds[order], where[order]))

    def diagonals(self, h: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Distinct rows (text, item, place of the item's first token in the text) that share a seed."""
        sizes_of = np.array(lengths, np.int64)
        begins, text = np.cumsum(sizes_of) - sizes_of, np.repeat(np.arange(len(lengths)), sizes_of)
        found = [np.empty((0, 3), np.int64)]
        for mask, seeds, where in self.seeds:
            own = spaced(h, mask)
            if not len(own):
                continue
            low = np.searchsorted(seeds, own)
            hits = np.flatnonzero((seeds[np.minimum(low, len(seeds) - 1)] == own) & (text[: len(own)] == text[len(mask) - 1 :]))
            low = low[hits]
            counts = np.searchsorted(seeds, own[hits], "right") - low
            for i, j in portions(counts.tolist(), CHUNK):
                n = counts[i:j]
                at = np.repeat(hits[i:j], n)
                place = where[np.repeat(low[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                item = self.owner[place]
                found.append(np.unique(np.stack([text[at], item, at - begins[text[at]] - (place - self.starts[item])], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], np.ndarray, list[int]]]:
    """(ids, texts, token hashes end to end, numbers of tokens) of a portion of texts."""
    for batch in batches:
        values = batch.column(1).to_pylist()
        for i, j in portions(map(len, values)):
            split = [tokens(t) for t in values[i:j]]
            yield batch.column(0).slice(i, j - i), values[i:j], word_hashes([w for words in split for w in words]), list(map(len, split))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, hashes) of the items that have a token."""
    for ids, _, h, lengths in _texts(batches):
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, hashes], names=["item_id", "hashes"]).filter(pa.array(np.array(lengths) > 0))


def _found(ids: list, items: list, rows: list[tuple[int, int, int, int, int, int]]) -> pa.RecordBatch:
    """Rows of the result; ids and items name texts and items by number."""
    columns = [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([items[r[1]] for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], pa.int32()) for k in range(2, 6))], names=["doc_id", "item_", "first_token", "n_tokens", "n_matching", "n_item"])


FOUND = "doc_id long, item_ long, first_token int, n_tokens int, n_matching int, n_item int"


def by_broadcast(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps with items (item_, hashes) that are counted to be few; the texts are read once, without a shuffle."""
    rows = items.collect()
    known = Passages([np.array(r.hashes, np.int64).view(U) for r in rows])
    sent = texts.sparkSession.sparkContext.broadcast(cloudpickle.dumps((known, [r.item_ for r in rows])))  # by value: workers need no copy of this module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = pickle.loads(sent.value)
        for ids, _, h, lengths in _texts(batches):
            yield _found(ids.to_pylist(), names, list(known.judged(known.diagonals(h, lengths), h, lengths)))

    return texts.mapInArrow(run, FOUND)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item_, place): every seed of every item."""
    for batch in batches:
        for item, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            h = hashes.values.to_numpy().view(U)
            for mask in masks_of(len(h)):
                seeds = spaced(h, mask)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), item)), pa.array(np.arange(len(seeds), dtype=np.int32))], names=["seed", "item_", "place"])


def by_join(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps with any number of items: seeds of texts and items meet in a hash join, diagonals are judged text by text.

    A bitmap of fixed size (2 ** FILTER bits) goes to the texts first, so that few seeds which no item has are shuffled.
    """
    spark = texts.sparkSession
    seeds = written(items.mapInArrow(_item_seeds, "seed long, item_ long, place int"))
    cell = F.shiftrightunsigned("seed", 64 - FILTER)
    bits = seeds.select(F.shiftright(cell, 6).alias("word"), cell.bitwiseAND(63).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    words = np.zeros(1 << (FILTER - 6), np.int64)
    words[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(words)
    masks = ["1" * n for n in range(1, SHORTEST)] + list(MASKS)  # clean runs are no longer than that

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for ids, values, h, lengths in _texts(batches):
            text = np.repeat(np.arange(len(lengths)), lengths)
            begins = np.cumsum(lengths) - lengths
            found = [np.empty((0, 3), np.int64)]
            for mask in masks:
                own = spaced(h, mask)
                at = own >> U(64 - FILTER)
                met = (sent.value.view(U)[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
                hits = np.flatnonzero(met & (text[: len(own)] == text[len(mask) - 1 :])) if len(own) else np.array([], np.int64)
                found.append(np.stack([text[hits], own[hits].view(np.int64), hits - begins[text[hits]]], 1) if len(hits) else found[0])
            rows = np.concatenate(found)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            ends = pa.array(np.searchsorted(rows[:, 0], np.arange(len(lengths) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(lengths))), ids, pa.array(values, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(rows[:, 1])), pa.ListArray.from_arrays(ends, pa.array(rows[:, 2].astype(np.int32)))], names=["row_", "doc_id", "text", "seeds", "places"])
            row += len(lengths)

    own = written(texts.mapInArrow(run, "row_ long, doc_id long, text binary, seeds array<long>, places array<int>").where("size(seeds) > 0"))
    hits = own.select("row_", F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("at"))).alias("s")).select("row_", "s.seed", "s.at")
    diagonals = hits.join(seeds, "seed").select(F.col("row_").alias("of"), "item_", (F.col("at") - F.col("place")).alias("d")).distinct().join(items, "item_")

    def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        text = left["text"].to_pylist()
        if not text or not right.num_rows:
            return pa.Table.from_batches([_found([], [], [])])
        h = word_hashes(tokens(text[0]))
        known = Items([np.array(x, np.int64).view(U) for x in right["hashes"].to_pylist()])
        rows = np.stack([np.zeros(right.num_rows, np.int64), np.arange(right.num_rows), right["d"].to_numpy().astype(np.int64)], 1)
        return pa.Table.from_batches([_found(left["doc_id"].to_pylist(), right["item_"].to_pylist(), list(known.judged(rows, h, [len(h)])))])

    return own.select("row_", "doc_id", "text").groupBy("row_").cogroup(diagonals.groupBy("of")).applyInArrow(judge, FOUND)


def overlaps(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, first_token, n_tokens, n_matching, n_item): one row per diagonal of a text and an item that holds an overlap.

    An overlap is a stretch that scores LEAST, or four fifths of the item's tokens; items under SHORTEST tokens must match
    whole. Items with equal tokens are searched for once. Up to `block` tokens of the benchmark (counted) are broadcast, more
    are joined by hash. Null or empty texts overlap with nothing, items without a token are in no text; repeated rows and
    items, null doc_ids and null item_ids are each answered. An empty table gives an empty result. Other columns are not read.
    """
    texts = texts_of(documents)
    named = texts_in_batches(benchmark).select(F.col("item_id").cast("long").alias("item_id"), bytes_of("text").alias("text")).mapInArrow(_hashed, "item_id long, hashes array<long>")
    named = written(named.withColumn("item_", F.xxhash64("hashes")))
    items = named.groupBy("item_").agg(F.first("hashes").alias("hashes"))
    many = (items.agg(F.sum(F.size("hashes"))).first()[0] or 0) > block
    found = by_join(texts, items) if many else by_broadcast(texts, items)
    names = named.select("item_", "item_id")
    return found.join(names if many else F.broadcast(names), "item_").select("doc_id", "item_id", "first_token", "n_tokens", "n_matching", "n_item")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold an overlap; rows with a null doc_id stay, as an overlap can't name them."""
    name = fresh("bad", documents)
    bad = small(written(overlaps(documents, benchmark).select(F.col("doc_id").alias(name)).distinct()))
    return documents.join(bad, F.col("doc_id") == F.col(name), "left_anti")
