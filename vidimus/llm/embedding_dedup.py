"""Embedding near-duplicates by sorted projection passes, and an exact check of what they leave open.

Equal vectors of a label are one class. Each pass orders the classes of a label lexicographically by concatenated random
hyperplane signs and compares neighbours in that order within a window; verified pairs of all passes are united. The exact
check then compares the classes of a label tile by tile: it counts all links and names only pairs that the passes have left
unconnected. Its arithmetic grows with the square of a label's size; without it, links are those that a window meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, positions, scratch, small, texts_in_batches, written

COSINE = 0.93
#: Orders, signs that each concatenates, neighbours that are compared on one side, and places that a task compares.
PASSES, SIGNS, WINDOW, SPAN = 8, 62, 48, 1_024
#: Bytes of the vectors on one side of a tile of the exact check; a task reads two sides and multiplies them in strips.
TILE = 8_000_000


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the rows whose vectors are usable (no null or non-finite component, not zero), and those at length 1 in double precision."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    there = np.asarray(column.is_valid())
    for n in np.unique(lengths[there & (lengths > 0)]):
        rows = np.flatnonzero(there & (lengths == n))
        x = flat[starts[rows][:, None] + np.arange(n)].astype(np.float64)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        x, rows = x[good], rows[good]
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, class, vector): one row a usable vector; equal vectors of a label share a class."""
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for rows, x in _matrices(batch.column(2)):
            raw = [v.tobytes() for v in x]
            kinds = [xxhash.xxh3_64_intdigest(v, seed=int(k) & 0xFFFFFFFF) - (1 << 63) for v, k in zip(raw, labels[rows], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(kinds, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "class", "vector"])


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _signs(passes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, size, class, keys): the signs of one pass as one number, the first sign most significant."""
        weights = 1 << np.arange(SIGNS - 1, -1, -1)
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                planes = np.random.default_rng([11, int(size)]).standard_normal((size // 8, passes * SIGNS))
                keys = ((_vectors(part.column(3)) @ planes > 0).reshape(-1, passes, SIGNS) * weights).sum(axis=2)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(keys), pa.list_(pa.int64()))], names=["label", "size", "class", "keys"])

    return run


def _neighbours(cosine: float, window: int, spanning: bool) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        """Pairs within the cosine and the window of one stretch of an order; the later one is of the stretch itself, not carried over.

        With spanning only pairs that join what the stretch hasn't connected yet: fewer than it has vectors.
        """
        t = t.take(pa.array(np.argsort(t["position"].to_numpy())))
        x, names, own = _vectors(t["vector"]), t["class"].to_numpy(), t["own"].to_numpy(zero_copy_only=False)
        pairs, group = [np.empty((0, 2), np.int64)], np.arange(len(x))
        for at in range(0, len(x), 256):
            stop = min(len(x), at + 256)
            last = min(len(x), stop + window)
            later = np.arange(at, last)[None, :] - np.arange(at, stop)[:, None]
            i, j = np.nonzero((x[at:stop] @ x[at:last].T >= cosine) & (later > 0) & (later <= window) & own[at:last][None, :])
            i, j = at + i, at + j
            if spanning:
                joins = []
                for k in range(len(i)):
                    a, b = group[i[k]], group[j[k]]
                    if a != b:
                        group[group == max(a, b)] = min(a, b)
                        joins.append(k)
                i, j = i[joins], j[joins]
            pairs.append(np.sort(np.stack([names[i], names[j]], 1), axis=1))
        out = np.concatenate(pairs)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return run


def window_pairs(classes: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, spanning: bool = False) -> DataFrame:
    """(a, b): distinct pairs of classes that some pass brings within its window and whose cosine suffices; with spanning only as
    many as connect what each stretch of an order connects. classes: label, size, class, vector."""
    keys = texts_in_batches(classes.select("label", "size", "class", "vector")).mapInArrow(_signs(passes), "label long, size int, class long, keys array<long>")
    orders = positions(keys.select("label", "size", "class", F.posexplode("keys").alias("pass", "key")), ["pass", "label", "size"], ["key", "class"])
    # The last places of a stretch are carried over to the next one.
    block, carried = F.floor(F.col("position") / SPAN), F.col("position") % SPAN >= SPAN - window
    spread = orders.withColumn("block", F.explode(F.when(carried, F.array(block, block + 1)).otherwise(F.array(block)))).withColumn("own", F.col("block") == block)
    met = spread.join(classes.select("class", "vector"), "class").groupBy("pass", "label", "size", "block")
    return met.applyInArrow(_neighbours(cosine, window, spanning), "a long, b long").distinct()


def _met(cosine: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        """One tile: (class, near, None) with the rows within the cosine on the other side, and (class, None, other) for pairs not connected yet."""
        t = t.take(pa.array(np.argsort(t["block"].to_numpy(), kind="stable")))
        blocks, names, copies, x = t["block"].to_numpy(), t["class"].to_numpy(), t["copies"].to_numpy(), _vectors(t["vector"])
        group = np.unique(t["root"].to_numpy(), return_inverse=True)[1]
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        split = int(np.searchsorted(blocks, j)) if i < j else 0  # rows from there are compared with those before, or all with all
        own, other = (np.arange(split), np.arange(split, len(names))) if i < j else (np.arange(len(names)),) * 2
        near, joins = np.zeros(len(names), np.int64), []
        for at in range(0, len(own), 256):
            rows = own[at : at + 256]
            for to in range(0, len(other), 4_096):
                partners = other[to : to + 4_096]
                close = (x[rows] @ x[partners].T >= cosine) | (names[rows][:, None] == names[partners][None, :])
                near[rows] += close @ copies[partners]
                if i < j:
                    near[partners] += copies[rows] @ close
                for k, m in np.argwhere(close & (group[rows][:, None] != group[partners][None, :])):
                    a, b = group[rows[k]], group[partners[m]]
                    if a != b:
                        joins.append((int(names[rows[k]]), int(names[partners[m]])))
                        group[group == max(a, b)] = min(a, b)
        kinds = np.concatenate([names, np.array([a for a, _ in joins], np.int64)])
        counts = pa.array([*near.tolist(), *[None] * len(joins)], pa.int64())
        return pa.table({"class": pa.array(kinds, pa.int64()), "near": counts, "other": pa.array([*[None] * len(names), *(b for _, b in joins)], pa.int64())})

    return run


def checked(classes: DataFrame, roots: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(class, near, other): every class's number of rows within the cosine (its own included) by tile, and the pairs that join roots.

    Classes are dealt to sides by hash, so no label is ordered or gathered. A vector is sent once for every side of its label.
    """
    rows = classes.join(small(roots.withColumnRenamed("node", "class")), "class", "left").withColumn("root", F.coalesce("root", "class"))
    last = small(written(classes.groupBy("label", "size").agg(F.floor((F.count("*") - 1) * F.first("size") / tile).cast("int").alias("last"))))
    dealt = rows.join(last, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("last") + 1).cast("int"))
    sides = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
    sides = sides.select("label", "size", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "class", "root", "copies", "vector")
    return sides.groupBy("label", "size", "i", "j").applyInArrow(_met(cosine), "class long, near long, other long")


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE, exact: bool = True) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of embeddings.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id, link with
    nothing. Vectors of different lengths are never compared. Repeated rows and equal vectors are links of each other.
    Without exact, n_links counts the links that the passes meet. Only vec_id, label and embedding are read. An empty table
    gives an empty result.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = texts_in_batches(rows.where("vec_id is not null and label is not null"))
    with scratch(embeddings.sparkSession) as keep:
        signed = keep(written(usable.mapInArrow(_classed, "vec_id long, label long, class long, vector binary")))
        classes = signed.groupBy("label", "class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
        classes = written(classes.withColumn("size", F.length("vector")))
        pairs = written(window_pairs(classes, cosine, spanning=exact))
        roots = components(pairs)
        if exact:
            met = written(checked(classes, roots, cosine))
            near = met.where("other is null").groupBy("class").agg(F.sum("near").alias("near"))
            more = met.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))
            roots = components(written(pairs.union(more).distinct()))
        else:
            other = pairs.union(pairs.select("b", "a")).toDF("class", "b").join(classes.select(F.col("class").alias("b"), "copies"), "b")
            near = other.groupBy("class").agg(F.sum("copies").alias("others")).join(classes.select("class", "copies"), "class").select("class", (F.col("others") + F.col("copies")).alias("near"))
        placed = written(classes.select("class", "copies", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")))
        least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        known = placed.select("class", "root", "copies").join(near, "class", "left").join(least, "root")
        known = keep(written(known.select("class", (F.coalesce("near", "copies") - 1).alias("n_links"), "component_id")))
    linked = signed.select("vec_id", "class").join(known, "class").select("vec_id", "n_links", "component_id").distinct()
    # A repeated vec_id with different vectors has the links of all of them.
    linked = linked.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
