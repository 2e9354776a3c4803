"""Embedding whitening with principal components by FEAST contour integration.

Spark sums the integer vectors, then their centred covariance, in two passes over the table. The leading eigenvalues are
enclosed in intervals by inertia counts; for each interval a circle in the complex plane is integrated by quadrature: every
node is one task that solves a shifted system of the covariance. The sum of the solutions projects onto the interval's
eigenvectors, Rayleigh-Ritz extracts them, and the steps repeat until the residuals are at rounding. At the end inertia counts
verify that no interval has missed one. What the driver holds grows with the square of the dimension, never with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, texts_in_batches, written

# Fixed values of the contract: entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1_024, 100_000
#: Entries at or beyond it have no exact integer steps; their rows are dropped like those with non-finite entries.
LARGEST = 1 << 52
COMPONENTS = 8
#: Quadrature nodes on the upper half of a circle, and rounds of projection at most.
NODES, ROUNDS = 8, 40
#: Eigenvalues up to so many radii from a circle's centre have room in its block.
REACH = 1.5
#: A circle ends in a gap of at least this share of the eigenvalue above it, however many eigenvalues it then holds.
LEAST_GAP = 1e-4
EPS = np.finfo(np.float64).eps


class Fitted(NamedTuple):
    """n vectors with per-dimension sums; eigenvalues fall, the columns of vectors are their unit eigenvectors; total is the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as integers and the rest of it: x - whole is exact, so nothing is lost before the rest is taken off."""
        whole = [round(s / self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole, strict=True)])


def integers(column: pa.ListArray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length (or for one), the rows of usable vectors and their integers."""
    lengths, starts = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy()[:-1]
    there, flat = np.asarray(column.is_valid()), column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[there & (lengths > 0)]) if size is None else [size]:
        rows = np.flatnonzero(there & (lengths == n))
        x = np.floor(SCALE * flat[starts[rows][:, None] + np.arange(n)].astype(np.float64)) + SHIFT
        good = (np.isfinite(x) & (np.abs(x) < LARGEST)).all(axis=1)
        yield rows[good], x[good].astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, place, n, s) of every batch."""
    for batch in batches:
        for _, x in integers(batch.column(0)):
            size = x.shape[1]
            s = pa.array(x.sum(axis=0)).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([len(x)] * size, pa.int64()), s], names=["size", "place", "n", "s"])


def _products(centre: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(i, part, row): row i of the task's own sum of products of centred vectors."""
        whole, rest = centre
        held = np.zeros((len(whole), len(whole)))
        for batch in batches:
            for _, x in integers(batch.column(0), len(whole)):
                c = (x - whole) - rest
                held += c.T @ c
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), pa.array([part] * len(whole), pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], names=["i", "part", "row"])

    return run


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (*keys, row) with the arrays of equal keys added up."""

    def run(t: pa.Table) -> pa.Table:
        held = np.stack(t["row"].combine_chunks().to_numpy(zero_copy_only=False))
        return pa.table({**{k: t[k].slice(0, 1) for k in keys}, "row": pa.array([held.sum(axis=0)], pa.list_(pa.float64()))})

    return rows.select(*keys, "row").groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", row array<double>")


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the same eigenvalues, by Householder reflections."""
    a, squares = v.copy(), np.zeros(len(v) - 1)
    for k in range(len(v) - 1):
        x = a[k + 1 :, k].copy()
        squares[k] = x @ x
        x[0] += np.copysign(np.sqrt(squares[k]), x[0])
        if (length := np.linalg.norm(x)) > 0:
            x /= length
            low = a[k + 1 :, k + 1 :]
            p = low @ x
            p -= (x @ p) * x
            low -= 2 * (np.outer(p, x) + np.outer(x, p))
    return np.diag(a).copy(), squares


def above(diagonal: np.ndarray, squares: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """By Sylvester's law of inertia, the numbers of eigenvalues above the shifts: positive pivots of the shifted matrix."""
    least = EPS * EPS * max(1.0, float(np.abs(diagonal).max(initial=0)))
    held = lambda pivot: np.where(np.abs(pivot) < least, np.where(pivot < 0, -least, least), pivot)
    pivot = held(diagonal[0] - shifts)
    count = (pivot > 0).astype(int)
    for a, b in zip(diagonal[1:], squares, strict=True):
        pivot = held(a - shifts - b / pivot)
        count += pivot > 0
    return count


def bounds(diagonal: np.ndarray, squares: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count): disjoint intervals around at least the k largest eigenvalues, whose ends lie in gaps between them."""
    d = len(diagonal)
    off = np.sqrt(np.concatenate([[0], squares, [0]]))
    top, bottom = float((diagonal + off[:-1] + off[1:]).max()), float((diagonal - off[:-1] - off[1:]).min())
    width = max(top - bottom, 1e-3 * max(abs(top), abs(bottom)))
    top, bottom = top + 0.1 * width, bottom - 0.1 * width
    seen, gaps = k, {}
    while not gaps or max(gaps.values()) < LEAST_GAP:
        seen = min(d, seen + 16)
        low, high = np.full(seen, bottom), np.full(seen, top)
        for _ in range(48):  # the j-th eigenvalue is above low[j], not above high[j]
            middle = (low + high) / 2
            more = above(diagonal, squares, middle) > np.arange(seen)
            low, high = np.where(more, middle, low), np.where(more, high, middle)
        values = np.append((low + high) / 2, bottom)
        ends = range(k, seen + 1) if seen == d else range(k, seen)
        gaps = {j: (values[j - 1] - values[j]) / max(abs(values[j - 1]), abs(values[j])) for j in ends}
        if seen == d:
            break
    last = next((j for j in ends if gaps[j] > 0.05), max(gaps, key=gaps.get))
    cuts = [j for j in range(1, last) if values[j] < 0.6 * values[j - 1]] + [last]
    edges = [float((values[j - 1] + values[j]) / 2) for j in cuts]
    edges = [float(values[0] + 0.2 * (values[0] - edges[0])), *edges]  # nothing lies above
    counts = above(diagonal, squares, np.array(edges))
    return [(edges[i + 1], edges[i], int(counts[i + 1] - counts[i])) for i in range(len(cuts)) if counts[i + 1] > counts[i]]


def at_node(matrix: np.ndarray, circle: tuple[float, float], block: np.ndarray, node: int) -> np.ndarray:
    """What one node on the upper half adds to the contour integral; the lower half adds its conjugate."""
    centre, radius = circle
    way = radius * np.exp(1j * np.pi * (node + 0.5) / NODES)
    shifted = (centre + way) * np.eye(len(matrix)) - matrix
    return (way * np.linalg.solve(shifted, block.astype(complex))).real / NODES


def _solved(spark: SparkSession, v: object, circles: list[tuple[float, float]], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """For each circle (centre, radius), the block projected onto the eigenvectors inside; every node is solved by a task."""
    sent = spark.sparkContext.broadcast((circles, blocks))  # a few columns a circle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, (circles, blocks) = v.value, sent.value
        for batch in batches:
            for at in batch.column(0).to_pylist():
                out = at_node(matrix, circles[at // NODES], blocks[at // NODES], at % NODES)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out.tobytes()])], names=["at", "out"])

    n = len(circles) * NODES
    solved = dict(spark.range(0, n, 1, n).mapInArrow(run, "at long, out binary").collect())  # a few columns a node
    sent.unpersist()
    return [np.sum([np.frombuffer(solved[i * NODES + k]).reshape(b.shape) for k in range(NODES)], axis=0) for i, b in enumerate(blocks)]


def eigenpairs(spark: SparkSession, v: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors; fewer if the others are zero to rounding.

    Raises ArithmeticError if an interval does not yield as many eigenvalues as its inertia counts say.
    """
    norm = float(np.linalg.norm(v, 2)) if len(v) < 512 else float(np.linalg.norm(v))
    if norm == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    d, v = len(v), v / norm
    shape = tridiagonal(v)
    parts = bounds(*shape, min(k, d))
    circles = [((low + high) / 2, (high - low) / 2) for low, high, _ in parts]
    # A block has room for what lies near its circle too, by inertia: what lies outside fades by REACH ** (2 * NODES) a round.
    near = above(*shape, np.array([c + sign * REACH * r for c, r in circles for sign in (-1, 1)])).reshape(-1, 2)
    rng = np.random.default_rng(seed)
    blocks = [rng.standard_normal((d, min(d, int(low - high) + 2))) for low, high in near]
    sent = spark.sparkContext.broadcast(v)
    best: list[tuple[float, np.ndarray, np.ndarray]] = [(np.inf, np.zeros(0), np.zeros((d, 0)))] * len(parts)
    going = list(range(len(parts)))
    for _ in range(ROUNDS):
        made = _solved(spark, sent, [circles[i] for i in going], [blocks[i] for i in going])
        still = []
        for i, projected in zip(going, made, strict=True):
            low, high, count = parts[i]
            q, lengths, _ = np.linalg.svd(projected, full_matrices=False)
            q = q[:, lengths > 1e-6 * lengths[0]]  # the rest is outside of the circle, and rounding
            ritz, inner = np.linalg.eigh(q.T @ v @ q)
            blocks[i] = q @ inner
            residuals = np.linalg.norm(v @ blocks[i] - blocks[i] * ritz, axis=0)
            # A mixture of eigenvectors outside may have its value inside, but not a small residual.
            inside = np.flatnonzero((ritz > low) & (ritz <= high) & (residuals < 0.1 * circles[i][1]))[::-1]
            found = blocks[i][:, inside]
            error = float(residuals[inside].max(initial=0)) if len(inside) == count else np.inf
            if error < best[i][0]:
                better = error < best[i][0] / 2
                best[i] = (error, ritz[inside], found)
                if not better:
                    continue
            elif np.isfinite(best[i][0]):  # at rounding: no round improves it any more
                continue
            if error > 2 * EPS:
                still.append(i)
        going = still
        if not going:
            break
    sent.unpersist()
    for (low, high, count), (error, values, _) in zip(parts, best, strict=True):
        if len(values) != count or error > 1e-10:
            raise ArithmeticError(f"{len(values)} of {count} eigenvalues found in ({low * norm}, {high * norm}), residual {error}")
    values, vectors = np.concatenate([b[1] for b in best]), np.concatenate([b[2] for b in best], axis=1)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > 8 * d * EPS]
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order] * norm, vectors * sign


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Fitted | None:
    """The sums and leading components of all usable vectors of the commonest length (the shorter on a tie); None without any."""
    spark = embeddings.sparkSession
    rows = texts_in_batches(embeddings.select(F.col("embedding").cast("array<double>").alias("embedding")))
    with scratch(spark):
        sums = written(rows.mapInArrow(_sums, "size int, place int, n long, s decimal(38,0)").groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")))
        common = sums.where("place = 0 and n > 0").orderBy(F.desc("n"), "size").first()
        if common is None:
            return None
        mine = [int(r.s) for r in sums.where(F.col("size") == common["size"]).orderBy("place").collect()]  # a row a dimension
        known = Fitted(common.n, mine, np.zeros(0), np.zeros((len(mine), 0)), 0.0)
        parts = rows.mapInArrow(_products(known.centre()), "i int, part int, row array<double>")
        total = _added(_added(parts, ["i", "part"]), ["i"]).orderBy("i").collect()  # a row a dimension
    v = np.array([r.row for r in total]) / common.n
    v = (v + v.T) / 2
    return known._replace(total=float(np.trace(v)))._replace(**dict(zip(("values", "vectors"), eigenpairs(spark, v, components), strict=True)))


def _whitened(known: Fitted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    whole, rest = known.centre()
    axes = known.vectors / np.sqrt(known.values)
    left = [s - known.n * int(w) for s, w in zip(known.sums, whole, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(1), len(whole)):
                c = x - whole
                most = known.n * int(np.abs(c).max(initial=0)) + max(map(abs, left), default=0)
                if len(whole) * most * most < 1 << 63:
                    deviation = ((known.n * c - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    exact = (sum((known.n * a - b) ** 2 for a, b in zip(r, left, strict=True)) for r in c.tolist())
                    deviation = [y if y < 1 << 63 else None for y in exact]
                w = pa.array(list((c - rest) @ axes), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(deviation, pa.int64()), w], names=["vec_id", "deviation", "w"])

    return run


def whiten(embeddings: DataFrame, known: Fitted) -> DataFrame:
    """(vec_id, deviation, w): the usable vectors of the fitted length, projected and at unit variance. Narrow."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return texts_in_batches(rows).mapInArrow(_whitened(known), "vec_id long, deviation long, w array<double>")


def _identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    w: list[Column] = [F.element_at("w", i + 1) for i in range(k)]
    mean = white.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first()
    centred = [c - F.lit(m) for c, m in zip(w, mean, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = white.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(x - (i == j)) for x, (i, j) in zip(found, pairs, strict=True))


def whitening(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per usable row and component.

    Usable are vectors of the commonest length (the shorter on a tie) without null, non-finite or beyond LARGEST entries; other
    rows are dropped. Components are numbered from 1, with the largest entry of each positive. There are fewer if the vectors
    span fewer directions, and none for equal vectors or a single one: the result is empty then, as for an empty table.
    Repeated rows, repeated and null ids are each answered and count each. deviation is null where it does not fit a long.
    Eigenvalues that tie are numbered in any order. Only vec_id and embedding are read.
    """
    spark = embeddings.sparkSession
    known = fit(embeddings, components)
    if known is None or not len(known.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    with scratch(spark) as keep:
        white = keep(written(whiten(embeddings, known)))
        error = _identity_error(white, len(known.values))
    shares = F.array(*(F.lit(float(e / known.total)) for e in known.values))
    rows = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
