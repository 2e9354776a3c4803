"""The registered queries of the library's operators over the given tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import clock, inferred_preference, strong_exact_intent
from ..operators import ann
from ..operators import chunks as B
from ..operators import entities as G
from ..operators import evidence as E
from ..operators import jobs as I
from ..operators import lexical as L
from ..operators import library as LIB
from ..operators import quality as J
from ..operators import ranking as R
from ..operators import units as C
from ..operators import usage as H
from ..operators import vectors as V
from ..sources.discovery import plan_index_jobs, upsert_discovered
from ..sources.files import split_documents
from ..sources.urls import classify_source_urls
from . import adapters as A
from .search import lexical_fallback_search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = 1_706_600_000  # unix seconds; state queries take the time as a parameter


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


USAGE_SQL = """
WITH u AS (
  SELECT event_id, floor(epoch(ts))::BIGINT AS created_at, ts, CASE WHEN event_id % 2 = 0 THEN 'remote' ELSE 'local' END AS provider_mode,
         CASE event_type WHEN 'click' THEN 'asr' WHEN 'view' THEN 'embedding_text' WHEN 'purchase' THEN 'embedding_image' WHEN 'signup' THEN 'video_understanding' WHEN 'error' THEN 'search_query' END AS capability,
         'u-' || user_id AS item_id, json_extract_string(props, '$.k')::BIGINT AS input_tokens, CASE WHEN event_id % 7 <> 0 THEN value END AS estimated_usd
  FROM events)
SELECT {keys} count(*) AS events, count(*)::BIGINT AS requests, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, round(coalesce(sum(estimated_usd), 0), 4) AS estimated_usd,
       count(*) FILTER (estimated_usd IS NULL) AS unpriced_events
FROM u {group}"""


def _usage(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "events", F.col("request_count").alias("requests"), "input_tokens", F.round("estimated_usd", 4).alias("estimated_usd"), "unpriced_events")


@query(USAGE_SQL.format(keys="", group=""))
def usage_totals(spark, sf_dir):
    return _usage(H.usage_totals(A.usage_events(spark, sf_dir)))


@query(USAGE_SQL.format(keys="provider_mode AS mode,", group="GROUP BY provider_mode"))
def usage_by_mode(spark, sf_dir):
    return _usage(H.usage_by_mode(A.usage_events(spark, sf_dir)), "mode")


@query(USAGE_SQL.format(keys="item_id,", group="GROUP BY item_id"))
def usage_by_item(spark, sf_dir):
    return _usage(H.usage_by(A.usage_events(spark, sf_dir), "item_id"), "item_id")


@query(USAGE_SQL.format(keys="capability,", group="GROUP BY capability"))
def usage_by_capability(spark, sf_dir):
    return _usage(H.usage_by_capability(A.usage_events(spark, sf_dir)), "capability")


@query(USAGE_SQL.format(keys="strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,", group="GROUP BY 1"))
def daily_usage(spark, sf_dir):
    return _usage(H.daily_usage(A.usage_events(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd")), "day")


@query("SELECT event_id::VARCHAR AS id, floor(epoch(ts))::BIGINT AS created_at FROM events ORDER BY floor(epoch(ts))::BIGINT DESC, event_id::VARCHAR DESC LIMIT 50")
def recent_usage(spark, sf_dir):
    return H.recent_usage(A.usage_events(spark, sf_dir)).select("id", "created_at")


@query("SELECT lang, greatest(ceil(sum(length(text)) / 4.0), count(*))::BIGINT AS tokens FROM documents GROUP BY lang")
def estimated_tokens(spark, sf_dir):
    return H.estimate_tokens(A.table(spark, sf_dir, "documents"), ["lang"])


JOBS_SQL = """
WITH j AS (
  SELECT 'job-' || event_id AS id, 'u-' || user_id AS item_id, user_id,
         CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'queued' WHEN 'signup' THEN 'cancelled' WHEN 'error' THEN 'failed' END AS status,
         floor(epoch(ts))::BIGINT AS started_at, event_type, event_id FROM events),
f AS (SELECT *, CASE WHEN status NOT IN ('running', 'queued') THEN started_at + 60 END AS finished_at FROM j),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, coalesce(finished_at, started_at) DESC, id DESC) = 1)
"""


@query(JOBS_SQL + "SELECT id, item_id, status, started_at FROM l")
def latest_job_per_item(spark, sf_dir):
    return I.latest_logical_jobs(A.jobs(spark, sf_dir)).select("id", "item_id", "status", "started_at")


@query(JOBS_SQL + "SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'failed' AND user_id % 3 = 0) AS attention, 0::BIGINT AS refreshing FROM l")
def job_summary(spark, sf_dir):
    return I.job_summary(A.jobs(spark, sf_dir), A.job_items(spark, sf_dir))


@query(JOBS_SQL + "SELECT status AS stage, count(*) AS n FROM f WHERE status IN ('running', 'queued') GROUP BY status")
def stage_counts(spark, sf_dir):
    return I.stage_counts(A.jobs(spark, sf_dir))


@query(JOBS_SQL + f"SELECT id, status FROM f WHERE status IN ('queued', 'running') OR status = 'completed' AND finished_at >= {NOW} - 86400 OR status = 'failed' AND finished_at >= {NOW} - 7 * 86400")
def job_drawer(spark, sf_dir):
    return I.list_jobs(A.jobs(spark, sf_dir), NOW, scope="drawer").select("id", "status")


@query(JOBS_SQL + "SELECT CASE WHEN event_type <> 'error' THEN NULL WHEN 400 + event_id % 30 = 412 THEN 'platform_verification_required' WHEN 400 + event_id % 30 = 429 THEN 'rate_limited' WHEN 400 + event_id % 30 IN (401, 403) THEN 'download_forbidden' ELSE 'source_unavailable' END AS error_code, count(*) AS n FROM f GROUP BY 1")
def job_error_codes(spark, sf_dir):
    return I.classify_job_errors(A.jobs(spark, sf_dir)).groupBy("error_code").agg(F.count("*").alias("n"))


@query(JOBS_SQL + f"SELECT id, greatest(0, coalesce(finished_at, {NOW}) - started_at)::BIGINT AS elapsed, CASE WHEN status = 'running' THEN greatest(0, {NOW} - started_at)::BIGINT END AS eta FROM f")
def job_timing(spark, sf_dir):
    return I.job_timing(A.jobs(spark, sf_dir), NOW).select("id", F.col("elapsed").cast("long").alias("elapsed"), "eta")


SEGMENTS_SQL = r"""
WITH s AS (SELECT 'conv-' || conv_id AS item_id, 12.0::DOUBLE * turn AS st, 12.0::DOUBLE * turn + 12 AS en,
                  regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM conversations),
k AS (SELECT * FROM s WHERE text <> ''),
"""


@query(SEGMENTS_SQL + """
g AS (SELECT item_id, min(st) AS f, max(en) AS l, count(*) AS n FROM k GROUP BY item_id),
w AS (SELECT item_id, f + 10 * i AS b, i::BIGINT AS k, n FROM g, LATERAL (SELECT unnest(generate_series(0, CASE WHEN n = 1 THEN 0 ELSE ceil((l - f) / 10)::BIGINT - 1 END)) AS i))
SELECT w.item_id, w.k, CASE WHEN n = 1 THEN min(st) ELSE greatest(min(st), b) END AS start_sec, CASE WHEN n = 1 THEN max(en) ELSE least(max(en), b + 12) END AS end_sec, md5(string_agg(text, ' ' ORDER BY st, en, text)) AS digest
FROM w JOIN k ON k.item_id = w.item_id AND (n = 1 OR en > b AND st < b + 12) GROUP BY w.item_id, w.k, b, n""")
def transcript_windows(spark, sf_dir):
    return B.transcript_windows(A.segments(spark, sf_dir)).select("item_id", "k", "start_sec", "end_sec", F.md5("text").alias("digest"))


@query(SEGMENTS_SQL + "r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY st, en, text) - 1 AS ord, st FROM k) SELECT item_id, ord::INT AS ord, st AS start_sec FROM r")
def transcript_lines(spark, sf_dir):
    return B.transcript_lines(A.segments(spark, sf_dir)).select("item_id", "ord", "start_sec")


@query("SELECT 'conv-' || conv_id AS item_id, max(12.0::DOUBLE * turn + 12) AS duration_sec FROM conversations GROUP BY 1")
def media_duration(spark, sf_dir):
    return B.media_duration(A.segments(spark, sf_dir))


FRAMES_SQL = """
WITH c AS (SELECT 'conv-' || conv_id AS item_id, turn, 12.0::DOUBLE * turn AS s, 12.0::DOUBLE * turn + 12 AS e, FALSE AS f FROM conversations
           UNION ALL SELECT 'conv-' || conv_id, turn, 12.0::DOUBLE * turn + 5, 12.0::DOUBLE * turn + 15, TRUE FROM conversations WHERE turn % 2 = 0),
g AS (SELECT item_id, min(s) AS first, max(e) AS last FROM c GROUP BY item_id),
w AS (SELECT item_id, i::INT AS k, first + 25 * i AS ws, least(first + 25 * i + 30, greatest(last, first + 25 * i + 1)) AS we
      FROM g, LATERAL (SELECT unnest(generate_series(0, greatest(0, ceil((last - first - 30) / 25)::BIGINT))) AS i))
"""


@query(FRAMES_SQL + "SELECT item_id, k, ws AS window_start, we AS window_end FROM w")
def window_grid(spark, sf_dir):
    return C.window_grid(C.effective_times(A.media_chunks(spark, sf_dir)))


@query(FRAMES_SQL + "SELECT w.item_id, w.k, count(*) AS n FROM w JOIN c ON c.item_id = w.item_id AND c.s < w.we AND c.e > w.ws GROUP BY ALL")
def units_overlap_counts(spark, sf_dir):
    rows = C.effective_times(A.media_chunks(spark, sf_dir))
    return C.interval_overlap_join(rows, C.window_grid(rows)).groupBy("item_id", "k").agg(F.count("*").alias("n"))


@query("""
SELECT 'conv-' || c.conv_id AS item_id, c.turn AS turn, 12.0::DOUBLE * f.turn + 5 AS frame_start
FROM conversations c JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 2 = 0) f ON f.conv_id = c.conv_id
QUALIFY row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY abs(12.0 * f.turn + 5 - 12.0 * c.turn), f.turn) = 1""")
def nearest_frame(spark, sf_dir):
    targets = A.segments(spark, sf_dir).select("item_id", F.col("turn").cast("string").alias("target_id"), F.col("start_sec").alias("at")).distinct()
    return C.nearest_frame_asof(targets, A.frames(spark, sf_dir)).where("frame_start is not null").select("item_id", F.col("target_id").cast("long").alias("turn"), "frame_start")


@query()
def timed_units(spark, sf_dir):
    """Moments and image units of every conversation."""
    items = A.media_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.lit("talks").alias("source_label"))
    return C.build_timed_units(items, A.media_chunks(spark, sf_dir))


@query(r"""
SELECT 'doc-' || doc_id AS item_id, 'document' AS unit_kind, md5(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS digest FROM documents WHERE regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''""")
def document_units(spark, sf_dir):
    """The units of every document hold its whole text, in order, whatever its length; compared without white space."""
    items = A.document_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.col("source_id").alias("source_label"))
    units = C.build_document_units(items, A.document_pieces(spark, sf_dir))
    whole = units.groupBy("item_id", "unit_kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_index", "transcript_text"))), lambda s: s["transcript_text"]), "").alias("text"))
    return whole.select("item_id", "unit_kind", F.md5(F.regexp_replace("text", r"[\s\p{Z}]+", "")).alias("digest"))


@query()
def split_document_chunks(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.lit(1).alias("page"), "text")
    return split_documents(docs)


def _index(spark, sf_dir):
    """Each document's whole text as one searchable unit."""
    return A.document_chunks(spark, sf_dir).select(F.regexp_extract("item_id", r"(\d+)$", 1).alias("id"), "item_id", F.lit("document").alias("unit_kind"), "start_sec", "end_sec", F.col("text").alias("content_text"))


TOKENS_SQL = r"""
WITH d AS (SELECT doc_id::VARCHAR AS unit_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks, text FROM documents),
p AS (SELECT unit_id, len(toks) AS dl, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM d),
st AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM d),
q AS (SELECT item_id AS query_id, array_to_string(list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 3), ' ') AS q FROM benchmark),
"""


@query(TOKENS_SQL + r"""
qw AS (SELECT query_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(q, '\s+'), lambda w: array_to_string(regexp_extract_all(lower(w), '[\p{L}\p{N}]+'), ' ')), lambda t: t <> ''))) AS term FROM q),
qt AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS np FROM qw),
m AS (SELECT query_id, np, p.term, unit_id, dl, count(*) AS tf FROM p JOIN qt ON p.term = qt.term GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM m GROUP BY ALL),
sc AS (SELECT m.query_id, unit_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score, count(*) AS met, any_value(np) AS np
       FROM m JOIN df ON m.query_id = df.query_id AND m.term = df.term, st GROUP BY ALL)
SELECT query_id, unit_id, round(score, 5) AS score FROM sc WHERE met = np QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) <= 10""")
def bm25_top10(spark, sf_dir):
    """The best ten documents for the first words of every benchmark item."""
    found = L.bm25_search(A.text_queries(spark, sf_dir), _index(spark, sf_dir))
    return found.where("rank <= 10").select("query_id", "unit_id", F.round("score", 5).alias("score"))


@query(r"""
SELECT q.query_id, d.doc_id::VARCHAR AS unit_id
FROM (SELECT item_id AS query_id, translate(trim(array_to_string(list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 3), ' ')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS needle FROM benchmark) q
JOIN documents d ON contains(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), q.needle) WHERE needle <> ''
QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY d.doc_id::VARCHAR) <= 40""")
def literal_hits(spark, sf_dir):
    return L.literal_search(A.text_queries(spark, sf_dir), _index(spark, sf_dir)).select("query_id", "unit_id")


TOPK_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, e.vec_id AS point_key, greatest(0, least(1, list_cosine_similarity(q.v, e.embedding::DOUBLE[]))) AS similarity FROM q, embeddings e)
"""


@query(TOPK_SQL + "SELECT query_id, point_key, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_key) <= 10")
def vector_topk(spark, sf_dir):
    found = V.vector_topk(A.vector_queries(spark, sf_dir), A.unit_vectors(spark, sf_dir), 10)
    return found.select("query_id", "point_key", F.round("similarity", 6).alias("similarity"))


@query()
def ann_recall(spark, sf_dir):
    """Recall at 10 of the inverted file against the exact search, for every query vector."""
    queries, vectors = A.vector_queries(spark, sf_dir), A.unit_vectors(spark, sf_dir)
    return J.recall_at_k(ann.ann_topk(queries, vectors, 10), V.vector_topk(queries, vectors, 10), 10)


@query()
def lexical_search_hits(spark, sf_dir):
    """Ranked and collapsed hits with snippets, for every benchmark query."""
    units = _piece_units(spark, sf_dir)
    return lexical_fallback_search(A.text_queries(spark, sf_dir, None), units, A.document_items(spark, sf_dir)).select("query_id", "unit_id", "item_id", "rank", F.round("match_score", 5).alias("match_score"), "snippet")


def _units(spark, sf_dir):
    items = A.document_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.col("source_id").alias("source_label"))
    return C.build_document_units(items, A.document_chunks(spark, sf_dir))


def _piece_units(spark, sf_dir):
    """Units of whole documents, one a piece; written once, as a search reads them several times."""
    items = A.document_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.col("source_id").alias("source_label"))
    return stored(C.build_document_units(items, A.document_pieces(spark, sf_dir)))


@query()
def extractive_answers(spark, sf_dir):
    queries = A.text_queries(spark, sf_dir, None)
    hits = lexical_fallback_search(queries, _piece_units(spark, sf_dir), A.document_items(spark, sf_dir))
    return E.extractive_answer(queries, E.enrich_hits(hits, A.document_sources(spark, sf_dir)))


@query()
def hit_facets(spark, sf_dir):
    hits = lexical_fallback_search(A.text_queries(spark, sf_dir, None), _piece_units(spark, sf_dir), A.document_items(spark, sf_dir))
    kinds = R.hit_modality(hits, ["query_id", "unit_id"])
    return R.hit_facets(hits.join(kinds, ["query_id", "unit_id"]))


@query(r"""
SELECT item_id AS query_id, CASE WHEN regexp_matches(t, '\.pdf|\.doc|\.ppt|(^|[^0-9a-z])(pdf|docx|pptx)([^0-9a-z]|$)') THEN 'document' WHEN regexp_matches(t, '\.jpg|\.jpeg|\.png|\.webp') THEN 'image'
       WHEN regexp_matches(t, '(^|[^0-9a-z])(podcast|audio)([^0-9a-z]|$)') THEN 'audio' WHEN regexp_matches(t, '(^|[^0-9a-z])(clip|video)([^0-9a-z]|$)') THEN 'video' ELSE 'smart' END AS preference,
       strlen(t) >= 2 AND (regexp_matches(t, '[-_/.#0-9]') OR length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) >= 8 OR len(regexp_split_to_array(t, '[\s\p{Z}]+')) >= 2 OR length(t) > 2 AND t LIKE '"%"') AS exact_intent
FROM (SELECT item_id, translate(trim(text, E' \n\t'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)""")
def query_intents(spark, sf_dir):
    return A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), inferred_preference("text").alias("preference"), strong_exact_intent("text").alias("exact_intent"))


@query("SELECT 'doc-' || doc_id AS id, source AS source_id, 1::BIGINT AS chunk_count, 'indexed' AS status FROM documents ORDER BY doc_id DESC, 1 LIMIT 51")
def list_documents_page(spark, sf_dir):
    listed = LIB.list_items(A.document_items(spark, sf_dir), A.document_chunks(spark, sf_dir))
    return LIB.page(listed, [F.desc("indexed_at"), F.asc("id")])[0].select("id", "source_id", "chunk_count", "status")


@query("SELECT source AS id, count(*) AS n_items, count(*) FILTER (doc_id % 4 = 1) AS n_failed, source AS label FROM documents GROUP BY source")
def source_rollup(spark, sf_dir):
    """Items and failed items of every source; every fourth document has failed."""
    items = A.document_items(spark, sf_dir).withColumn("status", F.when(F.col("external_id").cast("long") % 4 == 1, "failed").otherwise(F.col("status")))
    return LIB.source_rollup(A.document_sources(spark, sf_dir), items).select("id", "n_items", "n_failed", "label")


@query("""
SELECT 'status' AS facet, 'indexed' AS value, count(*) AS n FROM documents HAVING count(*) > 0 UNION ALL SELECT 'content_type', 'document', count(*) FROM documents HAVING count(*) > 0
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'age', CASE WHEN (1706600000 - 1700000000 - doc_id) / 86400.0 <= 7 THEN 'week' WHEN (1706600000 - 1700000000 - doc_id) / 86400.0 <= 30 THEN 'month' ELSE 'older' END, count(*) FROM documents GROUP BY 2""")
def library_facets(spark, sf_dir):
    return LIB.library_facets(A.document_items(spark, sf_dir), NOW)


@query("SELECT user_id, max_by(value, (ts, event_id)) AS position_sec FROM events WHERE value >= 0 GROUP BY user_id")
def playback_positions(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    updates = e.select(F.col("user_id").alias("item_id"), F.struct("ts", "event_id").alias("updated_at"), F.col("value").alias("position_sec"))
    items = e.select(F.col("user_id").alias("id"), F.lit(None).cast("double").alias("duration_sec")).distinct()
    return LIB.playback_positions(updates, items).select(F.col("item_id").alias("user_id"), "position_sec")


@query()
def entity_summary(spark, sf_dir):
    """Entities that documents name, over all their mentions."""
    none = spark.createDataFrame([], "item_id string, result string")
    mentions = G.entity_mentions(A.document_items(spark, sf_dir), none, A.document_pieces(spark, sf_dir))
    return G.entity_summary(G.dedupe_mentions(mentions), None)


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'unsupported video host' ELSE 'other' END AS reject_reason FROM pages WHERE NOT regexp_matches(url, '^https?://([^/]*\\.)?(youtube\\.com|youtu\\.be|bilibili\\.com|b23\\.tv|localhost)') ")
def url_classes(spark, sf_dir):
    return classify_source_urls(A.table(spark, sf_dir, "pages")).select("page_id", F.coalesce("reject_reason", "kind").alias("reject_reason"))


@query("""
WITH r AS (SELECT d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id))
SELECT source, round(sum(quality) FILTER (rank <= 10) / 10.0, 6) AS precision_at_10, round(sum(quality / log2(rank + 1)) FILTER (rank <= 10), 6) AS gain FROM r GROUP BY source""")
def graded_precision(spark, sf_dir):
    """Precision and discounted gain at ten of documents ranked by length within their source, graded by labels."""
    docs, labels = A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels")
    both = labels.join(docs, "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 10")
    return both.groupBy("source").agg(F.round(F.sum("quality") / 10, 6).alias("precision_at_10"), F.round(F.sum(F.col("quality") / F.log2(F.col("rank") + 1.0)), 6).alias("gain"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_report(spark, sf_dir):
    found = J.percentile_report(A.table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("SELECT conv_id, turn, printf('%d:%02d', (12 * turn) // 60, (12 * turn) % 60) AS label FROM conversations")
def time_labels(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", clock(12.0 * F.col("turn")).alias("label"))


@query("SELECT 'conv-' || conv_id AS item_id, turn, 10.0::DOUBLE * turn AS start_sec, 10.0::DOUBLE * turn + 10 AS end_sec FROM conversations")
def keyframe_times(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    frames = c.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("item_id"), "turn", F.format_string("frame_%06d.jpg", F.col("turn") + 1).alias("frame_path"))
    return B.keyframes(frames).select("item_id", "turn", "start_sec", "end_sec")


@query("SELECT 'conv-' || conv_id AS item_id, count(*) AS n FROM conversations GROUP BY 1")
def display_transcripts(spark, sf_dir):
    return B.display_transcript(A.media_chunks(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("n"))


@query("SELECT 'conv-' || conv_id || ':transcript:' || lpad(turn::VARCHAR, 6, '0') AS id FROM conversations")
def chunk_ids(spark, sf_dir):
    rows = A.segments(spark, sf_dir).select("item_id", F.lit("transcript").alias("chunk_type"), F.col("turn").cast("int").alias("ord"))
    return B.assign_chunk_ids(rows).select("id")


@query("SELECT 'conv-' || conv_id || ':transcript:' || lpad(turn::VARCHAR, 6, '0') AS id FROM conversations WHERE 12 * turn <= 40 AND 12 * turn + 12 >= 20")
def chunks_in_range(spark, sf_dir):
    return LIB.list_chunks(A.media_chunks(spark, sf_dir), kind="transcript", start=20.0, end=40.0).select("id")


@query("SELECT 'conv-' || conv_id AS item_id, turn, greatest(12.0::DOUBLE * turn - 2, 0) AS clip_start, 12.0::DOUBLE * turn + 14 - greatest(12.0::DOUBLE * turn - 2, 0) AS clip_seconds FROM conversations")
def clip_windows(spark, sf_dir):
    return E.clip_windows(A.segments(spark, sf_dir)).select("item_id", "turn", "clip_start", "clip_seconds")


@query("""
WITH f AS (SELECT '/library/' || source || '/' || doc_id || '.txt' AS path, n_chars AS length, doc_id * 3600 AS modified FROM documents),
s AS (SELECT path, sum(length) OVER () - coalesce(sum(length) OVER (ORDER BY modified, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM f)
SELECT path FROM s WHERE left_over > 1000000""")
def retention_plan(spark, sf_dir):
    return I.retention_plan(_listing(spark, sf_dir), 1_000_000).select("path")


def _listing(spark, sf_dir):
    """Documents as files: their source is the folder, their length the size."""
    d = A.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("/library/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("n_chars").alias("length"), (F.col("doc_id") * 3600).alias("modified"))


@query("SELECT CASE WHEN source = 'src1' THEN 'first' WHEN source = 'src2' THEN 'second' ELSE 'other' END AS category, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1")
def storage_usage(spark, sf_dir):
    return I.storage_usage(_listing(spark, sf_dir), {"first": "/library/src1/", "second": "/library/src2/"}).select("category", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT 'doc-' || doc_id AS id FROM documents WHERE doc_id % 2 = 1")
def missing_files(spark, sf_dir):
    there = A.document_items(spark, sf_dir).where(F.col("indexed_at") % 2 == 0).select(F.col("raw_path").alias("path"))
    return I.missing_files(A.document_items(spark, sf_dir), there).select("id")


@query(JOBS_SQL + "SELECT item_id, count(*) AS n FROM f WHERE user_id % 3 <> 0 GROUP BY item_id")
def jobs_after_cascade(spark, sf_dir):
    """Jobs left once the failed items are deleted."""
    gone = A.job_items(spark, sf_dir).where("status = 'failed'").select(F.col("id").alias("item_id"))
    return I.cascade_delete(gone, {"jobs": A.jobs(spark, sf_dir)})["jobs"].groupBy("item_id").agg(F.count("*").alias("n"))


@query(JOBS_SQL + "SELECT id FROM f WHERE user_id % 3 = 0")
def orphan_jobs(spark, sf_dir):
    """Jobs whose item isn't among the indexed ones."""
    return I.orphan_jobs(A.jobs(spark, sf_dir), A.job_items(spark, sf_dir).where("status = 'indexed'")).select("id")


@query("SELECT event_id::VARCHAR AS id, round(CASE event_type WHEN 'click' THEN value / 60 * 0.006 WHEN 'view' THEN json_extract_string(props, '$.k')::BIGINT / 1000000.0 * 0.2 WHEN 'purchase' THEN 3 * 0.00012 END, 9) AS estimated_usd FROM events")
def estimated_costs(spark, sf_dir):
    model = F.when(F.col("capability") == "asr", "whisper-1").when(F.col("capability").startswith("embedding"), "gemini-embedding-2").otherwise("unknown")
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("audio_seconds"))
    rows = A.usage_events(spark, sf_dir).drop("audio_seconds", "image_count", "estimated_usd").join(e, "id").withColumn("model_id", model).withColumn("provider_type", F.lit("openai")).withColumn("base_url", F.lit(None).cast("string")).withColumn("image_count", F.lit(3))
    return H.estimate_cost(rows).select("id", F.round("estimated_usd", 9).alias("estimated_usd"))


@query("""
SELECT count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS rejects
FROM (SELECT event_id % 10 = 3 OR event_id % 11 = 4 OR event_id % 13 = 5 AS bad FROM events)""")
def validated_usage(spark, sf_dir):
    """Events of which some have a mode, a capability or a status that is not known."""
    rows, n = A.usage_events(spark, sf_dir), F.col("id").cast("long")
    rows = rows.withColumns({"provider_mode": F.when(n % 10 == 3, "elsewhere").otherwise(F.col("provider_mode")), "capability": F.when(n % 11 == 4, "telepathy").otherwise(F.col("capability")), "status": F.when(n % 13 == 5, None).otherwise(F.col("status"))})
    good, bad = H.validate_usage(rows)
    return good.agg(F.count("*").alias("good")).join(bad.agg(F.count("*").alias("rejects")))  # one row each


@query("SELECT 'doc-' || doc_id AS item_id, 'index_document' AS job_type FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0")
def planned_jobs(spark, sf_dir):
    """Documents that aren't indexed and have no active job."""
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    items = A.document_items(spark, sf_dir).withColumn("status", F.when(number % 3 == 0, "discovered").otherwise("indexed"))
    active = items.where(number % 2 == 0).select(F.col("id").alias("item_id"), F.lit("index_document").alias("job_type"), F.lit("running").alias("status"))
    return plan_index_jobs(items, active).select("item_id", "job_type")


@query("""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents)
SELECT source, doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 5 = 0 THEN 'discovered' ELSE 'indexed' END AS status FROM d WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0""")
def discovered_items(spark, sf_dir):
    """Documents merged with a new listing of every fifth one; listed ones that are tombstoned and not known stay out."""
    items = A.document_items(spark, sf_dir).withColumn("discovered_at", F.lit(None).cast("long"))
    number = F.col("external_id").cast("long")
    listed = items.where(number % 5 == 0).select("source_id", "external_id", "raw_path", "title", "content_type", F.lit(0).alias("ord"))
    dead = items.where(number % 7 == 0).select("source_id", "external_id", "raw_path")
    merged, _ = upsert_discovered(items.where(number % 5 != 0), listed, dead, NOW)
    return merged.select(F.col("source_id").alias("source"), "external_id", "status")


@query("""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'doc-' || doc_id ELSE source || ':x' || doc_id END AS id, source, CASE WHEN doc_id % 5 = 0 THEN 'y' || doc_id ELSE doc_id::VARCHAR END AS external_id,
       CASE WHEN doc_id % 5 = 0 AND doc_id % 4 = 2 THEN 'processing' WHEN doc_id % 5 = 0 THEN 'discovered' ELSE 'indexed' END AS status, doc_id % 5 = 0 AS changed
FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0""")
def discovered_shared_paths(spark, sf_dir):
    """Every second document is an item; a listing names each fifth one twice by its path, under two new ids one after the other."""
    number = F.col("external_id").cast("long")
    documents = A.document_items(spark, sf_dir).withColumn("raw_path", F.concat(F.lit("/d/"), "external_id"))
    items = documents.where(number % 2 == 0).withColumn("discovered_at", F.lit(None).cast("long"))
    items = items.withColumn("status", F.when((number % 5 == 0) & (number % 4 == 2), "processing").otherwise("indexed"))
    named = documents.where(number % 5 == 0)
    listing = lambda letter, path, ord: named.select("source_id", F.concat(F.lit(letter), "external_id").alias("external_id"), path.alias("raw_path"), "title", "content_type", F.lit(ord).alias("ord"))
    listed = listing("x", F.col("raw_path"), 0).union(listing("y", F.concat(F.lit(" "), "raw_path"), 1))
    merged, changed = upsert_discovered(items, listed, items.limit(0).select("source_id", "external_id", "raw_path"), NOW)
    moved = changed.select(F.col("item_id").alias("id"), F.lit(True).alias("changed"))
    return merged.join(moved, "id", "left").select("id", F.col("source_id").alias("source"), "external_id", "status", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("SELECT 'doc-' || doc_id || ':unit:000000' AS unit_id FROM documents WHERE regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') <> ''")
def searchable_units(spark, sf_dir):
    return L.searchable_units(_units(spark, sf_dir), A.document_items(spark, sf_dir)).select("unit_id")


@query("SELECT 'u-' || user_id AS id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def requeued_jobs(spark, sf_dir):
    """Jobs that were running when the service stopped, by item."""
    jobs = A.jobs(spark, sf_dir)
    queued, _ = I.requeue_interrupted(jobs, A.job_items(spark, sf_dir))
    was = jobs.where("status = 'running'").select("id")
    return queued.where("status = 'queued'").join(was, "id", "left_semi").groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT d.source AS query_type, d.doc_id, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT query_type, count(*) AS relevant FROM r WHERE quality > 0 GROUP BY 1),
h AS (SELECT query_type, count(*) AS hits, min(rank) AS first FROM r WHERE quality > 0 AND rank <= 10 GROUP BY 1)
SELECT query_type, 1::BIGINT AS queries, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(hits, 0) / 10.0, 6) AS "precision", round(coalesce(1.0 / first, 0), 6) AS mrr FROM g LEFT JOIN h USING (query_type)""")
def relevance_report(spark, sf_dir):
    """Each source as a query, its labelled documents ranked by length, graded by quality."""
    both = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents"), "doc_id")
    ranked = both.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.lit(None).cast("double").alias("start_sec"))
    truth = both.select(F.col("source").alias("query_id"), F.col("source").alias("query_type"), F.col("doc_id").alias("id"), F.col("quality").alias("grade"), F.lit(None).cast("double").alias("start_sec"), F.lit(None).cast("double").alias("end_sec"))
    return J.relevance_eval(ranked, truth).select("query_type", "queries", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")])
