"""N-gram Jaccard join by parity sketches.

A document's set (distinct 5-word shingles, hashed to 64 bits) is dealt into m parts by hash range and every part is
XOR-ed to one word: its parity. A shingle that only one of two sets holds changes exactly one part, so the number of
parts that differ is at most the symmetric difference, and so is the Hamming distance of bit sketches. Sets with
Jaccard similarity >= 0.8 differ in at most (|A|+|B|)/9 shingles; by the pigeonhole, ordering the parts by one global
order (fullest first, then hash) and keeping one more than that many of each set leaves every such pair with an equal
part. Sizes are banded by powers of two; a second family of parts serves pairs across a band's edge. Equal parts give
candidates, bit sketches discard most of the rest, and whole sets decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mixed, portions, scratch, small, texts_of, word_hashes, written

WORDS = 5  # of a shingle
SAMPLE, WIDESPREAD = 8_000, 100_000  # documents, shingles
#: Members of a key whose pairs are listed one by one; those of larger keys are compared in blocks.
FEW, BLOCK = 32, 2_048
#: Candidate pairs that are all decided in one go.
AT_ONCE = 500_000
#: Sets that a task remembers, so that their keys are made once.
SEEN = 200_000
U = np.uint64
MULTIPLIER = U(0x9E3779B97F4A7C15)


def most_different(s: int, t: int) -> int:
    """The largest symmetric difference of sets of sizes s and t whose similarity is 0.8 or more."""
    return (s + t) // 9


def families(s: int) -> Iterator[tuple[int, int, int]]:
    """(family, parts, kept) for a set of s shingles: its band, and the edges of bands that a similar set can lie across."""
    top = 1 << s.bit_length()  # s < top <= 2 s
    yield 2 * top, top // 3 + 2, most_different(s, min(s * 5 // 4, top - 1)) + 1
    if s * 5 // 4 >= top:
        yield 2 * top + 1, top * 2 // 5 + 2, most_different(s, s * 5 // 4) + 1
    edge = top >> 1  # edge <= s
    if -(-s * 4 // 5) <= edge - 1:
        yield 2 * edge + 1, edge * 2 // 5 + 2, most_different(s, edge - 1) + 1


def signature(sets: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The keys of a sorted set: two sets with similarity 0.8 or more have one in common.

    frequent (sorted) only moves parts made of widespread shingles to the end of the order, so that a passage which many
    texts share makes no keys where other parts suffice.
    """
    out = []
    at = np.searchsorted(frequent, sets) if len(frequent) else None
    rare = np.ones(len(sets), np.int64) if at is None else (frequent[np.minimum(at, len(frequent) - 1)] != sets).astype(np.int64)
    for family, parts, kept in families(len(sets)):
        part = (sets >> U(32)) * U(parts) >> U(32)  # grows with the hash: equal parts are neighbours
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        count = np.diff(np.append(first, len(sets))).astype(U)
        keys = mixed(np.bitwise_xor.reduceat(sets, first) * MULTIPLIER + part[first] * U(0xD6E8FEB86659FD93) + count + U(family << 32))
        if len(keys) > kept:
            keys = keys[np.lexsort((keys, -count.astype(np.int64), -np.add.reduceat(rare, first)))[:kept]]
        elif len(keys) < kept:  # empty parts come last in the order
            empty = np.setdiff1d(np.arange(parts, dtype=U), part[first])
            blank = np.sort(mixed(empty * U(0xA0761D6478BD642F) + U(family)))
            keys = np.concatenate([keys, blank[: kept - len(keys)]])
        out.append(keys)
    return np.unique(np.concatenate(out))


def sketch(sets: np.ndarray) -> bytes:
    """A parity sketch of at least 8 bits a shingle, a power of two of them: it folds to any smaller one."""
    bits = max(256, 1 << (8 * len(sets) - 1).bit_length())
    return np.packbits((np.bincount((sets & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    if len(y) > len(x):  # positions are taken modulo the size, so folding adds blocks
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted set of each text: its 5-word shingles, or its whole sequence if it has fewer words."""
    split = [t.lower().split() for t in texts]
    all_words = word_hashes([w for words in split for w in words])
    if len(all_words) >= WORDS:
        rolled = all_words[: len(all_words) - WORDS + 1].copy()
        for k in range(1, WORDS):
            rolled = rolled * MULTIPLIER + all_words[k : len(all_words) - WORDS + 1 + k]
        rolled = mixed(rolled)
    at = 0
    for words in split:
        n = len(words)
        if n >= WORDS:
            yield np.unique(rolled[at : at + n - WORDS + 1])
        elif n:
            yield np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], U)
        else:
            yield np.array([], U)
        at += n


def _described(frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document; keys and sketch only at a set's first appearance in the task, and not at all for empty sets."""
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in portions(map(len, texts)):
                sizes, classes, keys, sketches = [], [], [], []
                for s in shingle_sets(texts[i:j]):
                    c = class_of(s)
                    new = len(s) > 0 and c not in seen
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(c)
                    sizes.append(len(s))
                    classes.append(c)
                    keys.append(signature(s, frequent).view(np.int64) if new else None)
                    sketches.append(sketch(s) if new else None)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "class", "keys", "sketch"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in portions(map(len, texts)):
            held = np.concatenate([np.array([], U), *shingle_sets(texts[i:j])])
            each, times = np.unique(held, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(times.astype(np.int64))], names=["item", "times"])


def widespread(texts: DataFrame) -> np.ndarray:
    """Shingles that stand in many documents, as far as about SAMPLE of them tell. They order keys; no result depends on them."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % every == 0)
    often = some.mapInArrow(_shingles, "item long, times long").groupBy("item").agg(F.sum("times").alias("times")).where(F.col("times") >= SAMPLE // 500)
    rows = often.orderBy(F.desc("times"), "item").limit(WIDESPREAD).select("item").collect()
    return np.sort(np.array([r.item for r in rows], np.int64).view(U))


def class_of(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in portions(map(len, texts)):
            sets = list(shingle_sets(texts[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "items"])


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """hamming() of many pairs, by size."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(min(len(x), len(y)), max(len(x), len(y))) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for low, high in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == (low, high)).all(axis=1))
        for at in range(0, len(rows), max(1, 4_000_000 // int(high))):
            some = rows[at : at + max(1, 4_000_000 // int(high))]
            x = np.frombuffer(b"".join(min(a[k], b[k], key=len) for k in some), U).reshape(len(some), -1)
            y = np.frombuffer(b"".join(max(b[k], a[k], key=len) for k in some), U).reshape(len(some), int(high // low), -1)
            out[some] = np.bitwise_count(x ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1)
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sketches allow a similarity of 0.8."""
    for batch in batches:
        far = distances(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(far / both)], names=["a", "b", "far"]).filter(pa.array(far <= both // 9))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides on whole sets: 100 * |A and B| >= 80 * |A or B|."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
            both = len(s) + len(t) - len(np.union1d(s, t))
            keep.append(100 * both >= 80 * (len(s) + len(t) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def ngram_jaccard(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, component_id): one row per row of documents.

    Words are what ASCII white space separates, A-Z lower-cased; a text of 1 to 4 words is one shingle. Null, empty or
    blank texts have no shingles and are alone: their component_id is their doc_id. Rows with a null doc_id take part;
    component_id is the smallest doc_id that is not null, or null where there is none. Repeated rows stay and are
    linked. Only doc_id and text are read, so other columns can't clash. An empty table gives an empty result.
    """
    texts = texts_of(documents)
    with scratch(documents.sparkSession) as keep:
        described = written(texts.mapInArrow(_described(widespread(texts)), "doc_id long, n_shingles long, class long, keys array<long>, sketch binary"))
        out = keep(written(described.select("doc_id", "n_shingles", "class")))
        roots = components(links(texts, described))
        classes = out.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
        placed = written(rooted(classes, "class", roots))
        least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        named = keep(written(placed.join(least, "root").select("class", "component_id")))
    return out.join(named, "class", "left").select("doc_id", "n_shingles", "class", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a range sorted by (key, class): each class with the first one of its key and the one before it.

    Rows of the first and the last key have an edge row beside them, with the first class itself, as their key may go on in
    another range; other keys with a single class are left out.
    """
    key = hub = last = None

    def edge() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (key, hub, hub, hub)] + [pa.array([True])], names=names)

    names, started = ["key", "class", "hub", "before", "edge"], False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, classes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not started:
            key = hub = last = None
        first = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
        hubs = np.where(at >= 0, classes[np.maximum(at, 0)], 0 if hub is None else hub)
        before = np.concatenate([[classes[0] if last is None else last], classes[:-1]])
        keep = ~first & (classes != hubs) & (classes != before)
        if keep.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (keys, classes, hubs, before)), pa.array(np.zeros(keep.sum(), bool))], names=names)
        if not started:
            key, hub, started = int(keys[0]), int(classes[0]), True
            yield edge()
        key, hub, last = int(keys[-1]), int(hubs[-1]), int(classes[-1])
    if started:
        yield edge()


def links(texts: DataFrame, described: DataFrame) -> DataFrame:
    """(a, b): links between classes of equal sets, enough of them that their components are those of all links.

    First each class meets the first class of its range and the one before it under every key, and its nearest two partners are decided.
    Then all pairs under a key that are still in different components are candidates, decided nearest first.
    """
    own = described.where("keys is not null")
    # Ranges, not groups: a key that many classes share reaches over several tasks.
    ranges = own.select(F.explode("keys").alias("key"), "class").repartitionByRange("key", "class").sortWithinPartitions("key", "class")
    groups = written(ranges.mapInArrow(_runs, "key long, class long, hub long, before long, edge boolean"))
    # Keys at the ends of ranges may go on in the next one: the first classes of their parts meet too.
    parts = groups.where("edge").select("key", "class").distinct()
    parts = parts.withColumn("before", F.lag("class").over(Window.partitionBy("key").orderBy("class"))).where("before is not null").select(F.col("class").alias("b"), F.col("before").alias("a"))
    # A class has one row for every task that met it.
    facts = written(own.groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    pairs = groups.where("not edge").select(F.col("class").alias("b"), F.explode(F.array_distinct(F.array("hub", "before"))).alias("a")).union(parts).distinct()
    found = written(similar(nearest(written(near(pairs, facts)), 2), texts, described))
    members = groups.select("key", "class").union(groups.select("key", F.col("hub").alias("class"))).distinct()
    members = rooted(members, "class", components(found))
    open_keys = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.min("class").alias("least")).where("low <> high").select("key", "size", "least")
    members = written(members.join(open_keys, "key"))
    few = members.where(F.col("size") <= FEW)
    other = few.select("key", F.col("class").alias("b"), F.col("root").alias("root_b"))
    listed = few.join(other, "key").where("class < b and root <> root_b").select(F.col("class").alias("a"), "b").distinct()
    rest = written(near(listed, facts).union(near_in_blocks(members.where(F.col("size") > FEW), facts)).distinct())
    for most in (2, 16):  # many candidates are first thinned by what their nearest ones join
        if rest.limit(AT_ONCE + 1).count() <= AT_ONCE:
            break
        now = written(nearest(rest, most))
        found = written(found.union(similar(now, texts, described)))
        roots = components(found)
        rest = rooted(rooted(rest.join(now, ["a", "b"], "left_anti"), "a", roots).withColumnRenamed("root", "root_a"), "b", roots)
        rest = written(rest.where("root_a <> root").select("a", "b", "far"))
    return found.union(similar(rest.select("a", "b"), texts, described))


def rooted(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    return df.join(small(roots.withColumnRenamed("node", column)), column, "left").withColumn("root", F.coalesce("root", column))


def nearest(pairs: DataFrame, most: int) -> DataFrame:
    by_b = Window.partitionBy("b").orderBy("far", "a")
    return pairs.withColumn("rank", F.row_number().over(by_b)).where(F.col("rank") <= most).select("a", "b")


def near(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, far) of the pairs that sizes and sketches allow; far is their distance as a share of both sizes."""
    left = facts.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = facts.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(small(left.drop("sa")), "a").join(small(right.drop("sb")), "b").where("10 * least(na, nb) >= 8 * greatest(na, nb)")
    both = both.join(left.drop("na"), "a").join(right.drop("nb"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, "a long, b long, far double")


def near_in_blocks(members: DataFrame, facts: DataFrame) -> DataFrame:
    """As near, for all pairs of different components among the members that large keys connect.

    No pair is listed before its sketches allow it: members are dealt into blocks, and two blocks meet in one task.
    """
    edges = members.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    clusters = components(edges).withColumnRenamed("root", "cluster").withColumnRenamed("node", "class")
    placed = members.select("class", "root").distinct().join(clusters, "class")
    placed = written(placed)
    last = small(written(placed.groupBy("cluster").agg(F.floor((F.count("*") - 1) / BLOCK).cast("int").alias("last"))))
    placed = placed.join(last, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("last") + 1).cast("int"))
    meeting = placed.join(facts, "class").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
    meeting = meeting.select("cluster", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "class", "root", "n", "sketch")
    return meeting.groupBy("cluster", "i", "j").applyInArrow(_blocks, "a long, b long, far double")


def _blocks(t: pa.Table) -> pa.Table:
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    block, name, root, n = (t[c].to_numpy() for c in ("block", "class", "root", "n"))
    length = np.array([len(x) for x in t["sketch"].to_pylist()])
    out: list[tuple[int, int, float]] = []
    matrix = {size: np.frombuffer(b"".join(x for x in t["sketch"].to_pylist() if len(x) == size), U).reshape(-1, size // 8) for size in np.unique(length)}
    for size, x in matrix.items():
        for other in (size, 2 * size):
            if other not in matrix:
                continue
            y = matrix[other] if other == size else np.bitwise_xor.reduce(matrix[other].reshape(len(matrix[other]), 2, -1), axis=1)
            rows, columns = np.flatnonzero(length == size), np.flatnonzero(length == other)
            for at in range(0, len(rows), 16):
                r = rows[at : at + 16]
                far = np.bitwise_count(x[at : at + 16, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                both = n[r][:, None] + n[columns][None, :]
                fits = (far <= both // 9) & (root[r][:, None] != root[columns][None, :])
                fits &= (block[r][:, None] == i) & (block[columns][None, :] == j) | (block[r][:, None] == j) & (block[columns][None, :] == i)
                fits &= 10 * np.minimum(n[r][:, None], n[columns][None, :]) >= 8 * np.maximum(n[r][:, None], n[columns][None, :])
                out += [(min(a, b), max(a, b), f) for a, b, f in ((int(name[r[p]]), int(name[columns[q]]), far[p, q] / both[p, q]) for p, q in np.argwhere(fits))]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "far": pa.array([x[2] for x in out], pa.float64())})


def similar(pairs: DataFrame, texts: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs whose whole sets decide for a link; one text of each class is read again."""
    pairs = written(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = written(described.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")))
    chosen = small(wanted.select(F.col("doc_id").alias("of")).distinct())
    sets = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").mapInArrow(_sets, "class long, items binary")
    sets = written(sets.join(small(wanted.select("class")), "class", "left_semi").groupBy("class").agg(F.first("items").alias("items")))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_similar, "a long, b long")
