"""Approximate vector search (D24): an inverted file of lists with compact codes, stored once and searched by tables of queries.

Vectors are dealt to the nearest of a number of centres. A list is a partition of the stored tables, so lists that no query
probes are never read. The scan reads tiles of four-bit codes, an eighth of the vectors' bytes; the best of a widened pool are
compared again with the vectors themselves. Queries meet tiles by an equi-join on the list, block by tile, so neither a query
table nor vectors pass through the driver, and no pair of a query and a vector is a row before it is among a task's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import shared_path, stored
from .vectors import Best, matrix_of, scores, vector_topk

#: Bytes of centres that a search broadcasts at most; bounds the number of lists by the dimension.
CENTRE_BYTES = 64 << 20
#: Vectors of a tile, vectors of a list in one file, rows and bytes of a table that is broadcast, at most.
TILE, FILE_ROWS, HINT_ROWS, HINT_BYTES = 1_024, 250_000, 1_000_000, 64 << 20
#: A list with more than so many times the mean of the sample is split.
BALANCE, SPLITS = 3.0, 3
#: Sixteen steps of this share of a dimension's standard deviation lose least of normally distributed values.
STEP = 0.335
#: Vectors asked to find how many lists a recall takes.
ASKED = 100


class InvertedFile(NamedTuple):
    """path holds vectors and tiles, by list; centres have length 1; steps: of each dimension's code; probes: lists that the wanted recall
    took; key: the type of point_key."""

    path: str
    centres: np.ndarray
    steps: np.ndarray
    probes: int
    key: str


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(_units(x[i : i + 4096]) @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)]).astype(np.int32)


def encoded(residuals: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Four bits a dimension, two to a byte."""
    codes = np.clip(np.floor(residuals / steps) + 8, 0, 15).astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def decoded(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), 2 * codes.shape[1]), np.float32)
    out[:, ::2], out[:, 1::2] = codes >> 4, codes & 15
    return (out[:, : len(steps)] - np.float32(7.5)) * steps.astype(np.float32)


def _unit_features(rows: DataFrame, dim: int) -> DataFrame:
    """(features array<double>): the usable vectors at length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = matrix_of(batch.column(0), dim)
            x = x[(x != 0).any(axis=1)]  # nothing is near to nothing
            flat = pa.array(_units(x).ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), flat)], names=["features"])

    return rows.select("vector").mapInArrow(run, "features array<double>")


def _fitted(features: DataFrame, k: int, seed: int) -> np.ndarray:
    model = KMeans(k=k, seed=seed, maxIter=6, initSteps=1, distanceMeasure="cosine").fit(features.select(array_to_vector("features").alias("features")))
    return _units(np.array(model.clusterCenters()))


def _sizes(features: DataFrame, centres: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The sample with the list of each row, and the number of rows of each list."""
    sent = features.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = matrix_of(batch.column(0), sent.value.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest_centres(x, sent.value))], names=["features", "list"])

    placed = features.mapInArrow(run, "features array<double>, list int")
    found = dict(placed.groupBy("list").count().collect())  # a row a list
    return placed, np.array([found.get(i, 0) for i in range(len(centres))])


def balanced_centres(features: DataFrame, lists: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(centres, rows of the sample in each list): lists far above the mean are clustered again on their own, a few times at most."""
    centres = _fitted(features, lists, seed)
    placed, sizes = _sizes(features, centres)
    for _ in range(SPLITS):
        big = np.flatnonzero(sizes > BALANCE * max(1.0, sizes.sum() / lists))
        if not len(big):
            break
        parts = [np.delete(centres, big, axis=0)]
        for i in big:
            share = max(2, round(float(sizes[i]) * lists / max(1, sizes.sum())))
            parts.append(_fitted(placed.where(F.col("list") == int(i)), min(share, int(sizes[i])), seed))
        new = np.unique(np.concatenate(parts).round(12), axis=0)
        if len(new) <= len(centres):  # equal vectors cannot be told apart
            break
        centres = _units(new)
        placed, sizes = _sizes(features, centres)
    return centres, sizes


def _steps(features: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The code's step of each dimension, from the sample's distances to the nearest centres."""
    sent = features.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(sent.value.shape[1]), 0
        for batch in batches:
            _, x = matrix_of(batch.column(0), sent.value.shape[1])
            held, n = held + ((x - sent.value[nearest_centres(x, sent.value)]) ** 2).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(held), pa.array([n] * len(held), pa.int64())], names=["place", "s", "n"])

    found = features.mapInArrow(run, "place int, s double, n long").groupBy("place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("place").collect()  # a row a dimension
    return STEP * np.sqrt(np.array([r.s / max(1, r.n) for r in found])) + 1e-12


def inverted_file(vectors: DataFrame, lists: int | None = None, sample: int = 50_000, seed: int = 1, recall: float = 0.95, path: str | None = None) -> InvertedFile:
    """The index of vectors (point_key, vector), stored below path or the shared folder. Cosine.

    Centres and code steps are fitted on at most about sample vectors of the commonest length, every one of that length is
    indexed; others are no one's neighbours. The default number of lists is the square root of the number of vectors, as far
    as CENTRE_BYTES allow. probes is the number of lists that held the wanted share of the ten nearest of ASKED vectors.
    Large lists are dealt to several files, so no list is gathered in one task.
    """
    spark, path = vectors.sparkSession, path or shared_path(vectors.sparkSession)
    kind = vectors.schema["point_key"].dataType
    total = vectors.count()
    common = vectors.groupBy(F.size("vector").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    dim = common.n if common else 1
    lists = max(1, min(lists or int(total**0.5), CENTRE_BYTES // (8 * dim)))
    rows = vectors.select("point_key", F.col("vector").cast("array<float>").alias("vector"))
    chosen = rows.where(F.pmod(F.xxhash64("point_key"), F.lit(max(1, total // sample))) == 0) if total > sample else rows
    features = stored(_unit_features(chosen, dim))
    there = features.count()
    centres, sizes = balanced_centres(features, min(lists, there), seed) if there else (np.zeros((1, dim)), np.zeros(1))
    steps = _steps(features, centres) if there else np.full(dim, 1e-12)
    files = np.maximum(1, np.ceil(sizes * (total / max(1, there)) / FILE_ROWS)).astype(np.int64)
    sent = spark.sparkContext.broadcast((centres, steps, files))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, steps, files = sent.value
        for batch in batches:
            at, x = matrix_of(batch.column(1), dim)
            own, x = nearest_centres(x, centres), _units(x)
            codes = encoded(x - centres[own], steps)
            salt = (batch.column(2).to_numpy()[at] % files[own]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in (0, 1)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own), pa.array(salt)], names=["point_key", "vector", "code", "list", "salt"])

    dealt = rows.withColumn("h", F.xxhash64("point_key")).mapInArrow(placed, f"point_key {kind.simpleString()}, vector array<float>, code binary, list int, salt int")
    dealt.repartition("list", "salt").drop("salt").sortWithinPartitions("list", "point_key").write.partitionBy("list").parquet(f"{path}/vectors")
    held = spark.read.schema(f"point_key {kind.simpleString()}, vector array<float>, code binary, list int").parquet(f"{path}/vectors")
    held.select("list", "point_key", "code").mapInArrow(_tiles(to_arrow_type(kind)), f"list int, keys array<{kind.simpleString()}>, codes binary").write.partitionBy("list").parquet(f"{path}/tiles")
    spark.createDataFrame([(i, c.tolist(), int(n)) for i, (c, n) in enumerate(zip(centres, sizes, strict=True))], "list int, centre array<double>, sampled long").write.parquet(f"{path}/centres")
    index = InvertedFile(path, centres, steps, len(centres), kind.simpleString())
    if there:
        index = index._replace(probes=probes_for(index, rows, recall))
    spark.createDataFrame([(steps.tolist(), index.probes, index.key)], "steps array<double>, probes int, key string").write.parquet(f"{path}/about")
    return index


def open_inverted_file(spark: SparkSession, path: str) -> InvertedFile:
    """An index that was stored before."""
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])
    about = spark.read.parquet(f"{path}/about").first()
    return InvertedFile(path, centres, np.array(about.steps), about.probes, about.key)


def _tiles(key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to TILE vectors of a list in one row."""
        for batch in batches:
            own = batch.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            own, batch = own[order], batch.take(pa.array(order))
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            spans = [(i, min(i + TILE, b)) for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True) for i in range(a, b, TILE)]
            keys = pa.array([batch.column(1).slice(a, b - a).to_pylist() for a, b in spans], pa.list_(key))
            codes = pa.array([b"".join(batch.column(2).slice(a, b - a).to_pylist()) for a, b in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([own[a] for a, _ in spans], pa.int32()), keys, codes], names=["list", "keys", "codes"])

    return run


def ranked_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest lists of each row, the nearest first."""
    near = _units(x) @ centres.T
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def probes_for(index: InvertedFile, vectors: DataFrame, recall: float, k: int = 10) -> int:
    """The least number of lists that holds the wanted share of the k nearest of ASKED stored vectors, compared with all vectors."""
    asked = vectors.where(F.size("vector") == index.centres.shape[1]).orderBy(F.xxhash64("point_key"), "point_key").limit(ASKED)
    queries = stored(asked.select(F.col("point_key").alias("query_id"), F.col("vector").alias("query_vector")))
    near = stored(vector_topk(queries, vectors, k).select("query_id", "point_key"))
    held = vectors.sparkSession.read.parquet(f"{index.path}/vectors").select("point_key", "list")
    lists = near.join(held.join(F.broadcast(near.select("point_key").distinct()), "point_key", "left_semi"), "point_key").groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    found = lists.join(queries, "query_id").collect()  # ASKED rows
    places = [np.flatnonzero(order == i)[0] + 1 for r in found for order in [ranked_lists(np.array([r.query_vector], np.float64), index.centres, len(index.centres))[0]] for i in r.lists]
    return int(np.quantile(places, recall, method="higher")) if places else len(index.centres)


def _probed(index: InvertedFile, probes: int, query_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(list, ids, queries): the queries of a batch that probe a list, as one matrix."""
        for batch in batches:
            at, x = matrix_of(batch.column(1), index.centres.shape[1])
            if not len(at):
                continue
            near = ranked_lists(x, index.centres, probes)
            order = np.argsort(near.ravel(), kind="stable")
            of, row = near.ravel()[order], np.repeat(np.arange(len(x)), probes)[order]
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            unit, ids = _units(x).astype(np.float32), batch.column(0).take(pa.array(at))
            groups = np.split(row, starts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int32)), pa.array([ids.take(pa.array(g)).to_pylist() for g in groups], pa.list_(query_type)), pa.array([unit[g].tobytes() for g in groups], pa.binary())], names=["list", "ids", "queries"])

    return run


def _pooled(index: InvertedFile, pool: int, types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dim, wide = index.centres.shape[1], -(-index.centres.shape[1] // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, list, point_key, similarity) of each query's pool in this task."""
        best, names, tiles = Best(pool), {}, []
        for batch in batches:
            for own, ids, queries, keys, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = np.frombuffer(queries, np.float32).reshape(-1, dim)
                x = decoded(np.frombuffer(codes, np.uint8).reshape(-1, wide), index.steps)
                score = q @ x.T + (q @ index.centres[own].astype(np.float32))[:, None]
                best.add(np.array([names.setdefault(i, len(names)) for i in ids]), np.arange(len(keys)) + len(tiles) * TILE, score.astype(np.float64))
                tiles.append((own, keys))
        if best.held:
            known = list(names)
            at, place, score = best.rows()
            where = [(tiles[p // TILE], p % TILE) for p in place.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([known[i] for i in at], types[0]), pa.array([t[0] for t, _ in where], pa.int32()), pa.array([t[1][i] for t, i in where], types[1]), pa.array(score)], names=["query_id", "list", "point_key", "similarity"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, point_key, similarity) of pairs with both vectors."""
    for batch in batches:
        if len(batch):
            size = len(batch.column(2)[0])
            (_, q), (_, x) = matrix_of(batch.column(2), size), matrix_of(batch.column(3), size)
            score = np.einsum("ij,ij->i", _units(q), _units(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(score, 0, 1))], names=["query_id", "point_key", "similarity"])


def ann_topk(queries: DataFrame, vectors: DataFrame | None, k: int = 10, lists: int | None = None, probes: int | None = None, index: InvertedFile | None = None, pool: int | None = None) -> DataFrame:
    """(query_id, point_key, similarity, rank) by an inverted file: codes of the nearest lists, then the vectors of the best pool. Cosine.

    index: inverted_file(vectors), to be built once; without it one is built. probes: lists that a query meets, by default as
    many as the index took for its recall. pool: candidates of a query that are compared exactly, 20 times k by default. Queries
    of another length or with missing components find nothing.
    """
    index = index or inverted_file(vectors, lists)
    spark, probes, pool = queries.sparkSession, min(probes or index.probes, len(index.centres)), pool or 20 * k
    query_kind, key = queries.schema["query_id"].dataType, index.key
    # With the schemas given, no file of a list is opened to find them.
    tiles = spark.read.schema(f"keys array<{key}>, codes binary, list int").parquet(f"{index.path}/tiles")
    held = spark.read.schema(f"point_key {key}, vector array<float>, list int").parquet(f"{index.path}/vectors")
    types = [to_arrow_type(query_kind), to_arrow_type(held.schema["point_key"].dataType)]
    asked = stored(queries.select("query_id", F.col("query_vector").cast("array<float>").alias("query_vector")).where("query_vector is not null"))
    n = asked.count()
    few_queries, few_pairs = n * probes * index.centres.shape[1] * 4 <= HINT_BYTES, n * pool <= HINT_ROWS
    blocks = asked.mapInArrow(_probed(index, probes, types[0]), f"list int, ids array<{query_kind.simpleString()}>, queries binary")
    # The condition on the list tells Spark that the join is worth a look before the partitions are listed.
    blocks = blocks.where("list >= 0")
    met = tiles.join(F.broadcast(blocks) if few_queries else blocks, "list").select("list", "ids", "queries", "keys", "codes")
    found = met.mapInArrow(_pooled(index, pool, types), f"query_id {query_kind.simpleString()}, list int, point_key {key}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "point_key")
    pooled = stored(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= pool).select("query_id", "list", "point_key").distinct()).where("list >= 0")
    pairs = held.join(F.broadcast(pooled) if few_pairs else pooled, ["list", "point_key"]).join(F.broadcast(asked) if few_queries else asked, "query_id")
    exact = pairs.select("query_id", "point_key", "query_vector", "vector").mapInArrow(_compared, f"query_id {query_kind.simpleString()}, point_key {key}, similarity double")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
