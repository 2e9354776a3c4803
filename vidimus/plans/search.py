"""A whole table of queries against a whole index: hybrid (D1-D20), lexical fallback (D21), old chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import or_null
from ..operators import ranking as R
from ..operators.jobs import items_needing_rebuild
from ..operators.lexical import LARGEST_POOL, bm25_search, hinted, lexical_candidates, literal_search, pool, searchable_units, top
from ..operators.vectors import score_lexical_only, vector_topk


def asked(queries: DataFrame) -> DataFrame:
    """The queries with the preference that holds. The candidates of each step are stored: they are few, and read more than once."""
    return queries.withColumn("preference", R.effective_preference())


def hybrid_search(queries: DataFrame, units: DataFrame, items: DataFrame, vectors: DataFrame, metric: str = "cosine", chunks: DataFrame | None = None) -> DataFrame:
    """Ranked hits of every query: vector top-k and lexical recall fused, hydrated, collapsed. vectors: point_key, unit_id, vector.

    With chunks, hits play from their best row and carry its frame, and chunks of items whose index is old are searched too.
    """
    queries = asked(queries)
    ready = stored(searchable_units(units, items))
    with_vector = queries.where("query_vector is not null")
    points = near_points(with_vector, vectors.join(ready, "unit_id", "left_semi"), metric)
    near = points.groupBy("query_id", "unit_id").agg(F.max("similarity").alias("similarity"))
    near = stored(top(near.join(hinted(queries.select("query_id", pool().alias("pool_"))), "query_id"), F.col("pool_"), F.desc("similarity"), F.asc("unit_id")).drop("pool_", "rank"))
    words = stored(lexical_candidates(queries, units, ready))
    scored = score_lexical_only(words, near, queries, vectors, metric).select("query_id", "unit_id", "exact_match", "score")
    both = words.select("query_id", "unit_id", "exact_match").join(near, ["query_id", "unit_id"]).select("query_id", "unit_id", "exact_match", F.col("similarity").alias("score"))
    return ranked(R.fuse_candidates(scored.unionByName(both), near, queries), queries, units, items, ready, chunks)


def near_points(queries: DataFrame, vectors: DataFrame, metric: str) -> DataFrame:
    """(query_id, unit_id, similarity) of the points nearest to each query, ties by unit: as many as surely hold the units of its pool, at most LARGEST_POOL.

    Of a pool's last unit the best point comes after points of better units only. Vectors are dealt to a task a core.
    """
    held = stored(vectors.select(F.col("unit_id").alias("point_key"), "vector").repartition(vectors.sparkSession.sparkContext.defaultParallelism))
    deepest = held.groupBy("point_key").count().agg(F.max("count")).first()[0]
    widest = queries.agg(F.max(pool())).first()[0]
    return vector_topk(queries.select("query_id", "query_vector"), held, min(LARGEST_POOL, (widest or 1) * (deepest or 1)), metric).select("query_id", F.col("point_key").alias("unit_id"), "similarity")


def lexical_fallback_search(queries: DataFrame, units: DataFrame, items: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Without vectors; pending items are searched too."""
    queries = asked(queries)
    ready = stored(searchable_units(units, items, pending=True))
    hits = lexical_candidates(queries, units, ready).select("query_id", "unit_id", "score", "exact_match", F.lit(True).alias("has_text"), F.lit(False).alias("has_vector"), F.lit(None).cast("double").alias("similarity"), F.col("rank").alias("hit_rank"))
    return ranked(hits, queries, units, items, ready, chunks)


def ranked(hits: DataFrame, queries: DataFrame, units: DataFrame, items: DataFrame, ready: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Candidates as ranked hits; with chunks the evidence is attached (D14-D16) and old chunks' hits join (D22) before the ranking."""
    found = R.hydrate(hits, units, items, ready).join(hinted(queries.select("query_id", "q", "preference")), "query_id")
    if chunks is None:
        return R.finalize(R.with_best_field(found).withColumn("snippet", R.snippet_of_best()).drop("best_"), queries)
    found = R.with_evidence(found, chunks)
    if not old_items(items).isEmpty():
        old = legacy_chunk_search(queries, chunks, items).join(hinted(queries.select("query_id", "q", "preference")), "query_id")
        found = found.unionByName(old, allowMissingColumns=True)
    return R.with_texts(R.finalize(stored(found), queries), units)


def old_items(items: DataFrame) -> DataFrame:
    """Indexed items that still need a rebuild."""
    return items_needing_rebuild(items).where("status = 'indexed'")


def legacy_chunk_search(queries: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Hits among the chunks of indexed items that still need a rebuild: words in four kinds of chunks, literals in all.

    A row a chunk, in the form of hydrated hits: flags OR-ed, the higher score, at most the pool of a query, words first.
    """
    old = old_items(items)
    rows = chunks.join(old.select(F.col("id").alias("item_id")), "item_id", "left_semi").where("text is not null").withColumn("unit_kind", F.lit(0))  # literal hits go by time alone
    words = bm25_search(queries, rows.where(F.col("chunk_type").isin("transcript", "audio", "ocr", "document")), None, "text").select("query_id", "unit_id", "score", F.lit(False).alias("exact_match"), F.lit(0).alias("arm"), "rank")
    literal = literal_search(queries, rows, None, "text").select("query_id", "unit_id", "score", "exact_match", F.lit(1).alias("arm"), "rank")
    merged = words.unionByName(literal).groupBy("query_id", "unit_id").agg(F.max("score").alias("score"), F.bool_or("exact_match").alias("exact_match"), F.min(F.struct("arm", "rank")).alias("place"))
    merged = top(merged.join(hinted(queries.select("query_id", pool().alias("pool_"))), "query_id"), F.col("pool_"), F.col("place"), F.col("unit_id")).drop("pool_", "rank", "place")
    of_item = old.select(F.col("id").alias("item_id"), "source_id", F.col("title").alias("item_title"), F.col("content_type").alias("item_content_type"), "indexed_at", "raw_path", F.col("duration_sec").alias("item_duration"))
    found = merged.join(rows.select(F.col("id").alias("unit_id"), "item_id", "chunk_type", "start_sec", "end_sec", F.col("text").alias("content_text")), "unit_id").join(of_item, "item_id")
    found = found.withColumns({"playback_chunk_id": F.col("unit_id"), "has_text": F.lit(True), "has_vector": F.lit(False), "similarity": F.lit(None).cast("double")})
    shown = F.when(F.col("chunk_type") != "understanding", F.left(or_null("content_text"), F.lit(R.SNIPPET)))
    return R.attach_nearest_frame(found, chunks).withColumn("snippet", F.coalesce(shown, R.placeholder()))
