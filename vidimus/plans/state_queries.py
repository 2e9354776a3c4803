"""Registered queries of the library, entities, usage, jobs and quality operators (F-J), with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import entities as G
from ..operators import jobs as I
from ..operators import library as LIB
from ..operators import quality as J
from ..operators import usage as H
from . import adapters as A
from .queries import JOBS_SQL, NOW, query


def _number(c: str = "id"):
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


def _pick(n, *values):
    """values[n % len(values)], as a column."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(n: str, *values: str) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


# H

def _rich_usage(spark, sf_dir) -> DataFrame:
    """Usage events in which every measure varies, and some modes, capabilities and statuses are outside their domains."""
    n = F.col("id").cast("long")
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "value")
    rows = A.usage_events(spark, sf_dir).join(e, "id")
    return rows.withColumns({
        "provider_mode": _pick(n, "remote", "local", "byok", "cloud", "self_host", "other"), "status": _pick(n, "ok", "failed", "ok", "lost", "ok", "ok", "cancelled"), "output_tokens": n % 7, "image_count": n % 4,
        "audio_seconds": F.round("value", 2), "video_seconds": (n % 5) * 1.5, "billed_credits": (n % 3) * 0.25,
    })


RICH_USAGE_SQL = f"""
WITH u AS (SELECT event_id, {_sql_pick("event_id", "remote", "local", "byok", "cloud", "self_host", "other")} AS provider_mode, {_sql_pick("event_id", "ok", "failed", "ok", "lost", "ok", "ok", "cancelled")} AS status,
                  json_extract_string(props, '$.k')::BIGINT AS input_tokens, event_id % 7 AS output_tokens, event_id % 4 AS image_count, round(value, 2) AS audio_seconds, (event_id % 5) * 1.5 AS video_seconds,
                  (event_id % 3) * 0.25 AS billed_credits, CASE WHEN event_id % 7 <> 0 THEN value END AS estimated_usd FROM events)
"""


@query(RICH_USAGE_SQL + """
SELECT CASE WHEN provider_mode IN ('remote', 'byok', 'cloud') THEN 'remote' ELSE 'local' END AS mode, count(*) AS events, count(*) AS request_count, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
       round(sum(audio_seconds), 2) AS audio_seconds, sum(image_count)::BIGINT AS image_count, round(sum(video_seconds), 2)::DOUBLE AS video_seconds, round(sum(estimated_usd), 4) AS estimated_usd,
       round(sum(billed_credits), 2)::DOUBLE AS billed_credits, count(*) FILTER (estimated_usd IS NULL) AS unpriced_events
FROM u WHERE provider_mode <> 'other' GROUP BY 1""")
def usage_measures(spark, sf_dir):
    """All ten measures by mode; modes that no rule knows are left out."""
    found = H.usage_by_mode(_rich_usage(spark, sf_dir))
    return found.withColumns({c: F.round(c, n) for c, n in (("audio_seconds", 2), ("video_seconds", 2), ("estimated_usd", 4), ("billed_credits", 2))})


@query(RICH_USAGE_SQL + """
SELECT t.reading, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS rejects
FROM (SELECT r.reading, status IN ('ok', 'success', 'failed', 'error', 'cancelled') AND (provider_mode IN ('local', 'remote') OR r.reading AND provider_mode IN ('self_host', 'byok', 'cloud')) AS good FROM u, (VALUES (TRUE), (FALSE)) AS r(reading)) t
GROUP BY t.reading""")
def usage_rejects(spark, sf_dir):
    """Usage rows within and outside the domains, as written and as read."""
    rows = _rich_usage(spark, sf_dir)
    counts = []
    for reading in (True, False):
        good, bad = H.validate_usage(rows, reading)
        counts.append(good.agg(F.count("*").alias("good")).join(bad.agg(F.count("*").alias("rejects"))).withColumn("reading", F.lit(reading)))  # one row each
    return counts[0].unionByName(counts[1])


@query(JOBS_SQL + " SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE item_id END AS item_id, count(*) AS n FROM f GROUP BY 1")
def usage_after_cascade(spark, sf_dir):
    """Usage keeps its rows when the failed items are deleted, but loses their key."""
    gone = A.job_items(spark, sf_dir).where("status = 'failed'").select(F.col("id").alias("item_id"))
    return I.cascade_delete(gone, {"usage": A.usage_events(spark, sf_dir)})["usage"].groupBy("item_id").agg(F.count("*").alias("n"))


# I

@query(JOBS_SQL + "SELECT id, status FROM f WHERE status IN ('running', 'queued') ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, started_at DESC, id DESC LIMIT 12")
def active_jobs(spark, sf_dir):
    return I.active_jobs(A.jobs(spark, sf_dir)).select("id", "status")


@query(JOBS_SQL + "SELECT (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 3 <> 0) AS indexed, 0::BIGINT AS pending, (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 3 = 0) AS failed, (SELECT count(*) FROM f WHERE status IN ('running', 'queued')) AS active")
def indexing_counts(spark, sf_dir):
    return I.indexing_counts(A.job_items(spark, sf_dir), A.jobs(spark, sf_dir))


FAILURES = ("ffmpeg: no such file or directory", "Invalid data found when processing input", "moov atom not found", "file not found: a.mp4", "rate limited", "source file missing", "corrupt header")


@query(f"""SELECT event_id, CASE WHEN regexp_matches(e, 'no such file|file not found|does not exist|missing source|source file') THEN 'missing_source' WHEN regexp_matches(e, 'invalid data|moov atom|unsupported codec|could not decode|corrupt') THEN 'unreadable_media' END AS code
FROM (SELECT event_id, lower({_sql_pick("event_id", *FAILURES)}) AS e FROM events)""")
def media_failures(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", I.classify_media_failure(_pick(F.col("event_id"), *FAILURES)).alias("code"))


@query(JOBS_SQL + """,
k AS (SELECT * FROM f WHERE status <> 'running'),
c AS (SELECT DISTINCT item_id FROM k WHERE status = 'queued' AND event_id % 2 = 0),
o AS (SELECT *, status = 'queued' AND event_id % 2 = 0 AS gone FROM k),
a AS (SELECT DISTINCT item_id FROM o WHERE status = 'queued' AND NOT gone)
SELECT o.item_id, count(*) FILTER (gone) AS cancelled, count(*) FILTER (status = 'queued' AND NOT gone) AS queued,
       CASE WHEN o.item_id IN (SELECT item_id FROM c) AND o.item_id NOT IN (SELECT item_id FROM a) THEN 'indexed' ELSE 'processing' END AS item_status
FROM o GROUP BY o.item_id""")
def cancelled_jobs(spark, sf_dir):
    """Every second queued job is cancelled; items without other active jobs are reset."""
    jobs = A.jobs(spark, sf_dir).where("status <> 'running'")
    items = A.job_items(spark, sf_dir).withColumn("status", F.lit("processing"))
    chosen = jobs.where((F.col("status") == "queued") & (_number() % 2 == 0)).select("id")
    after, reset = I.cancel_queued(jobs, items, chosen, NOW)
    was = jobs.select("id", F.col("status").alias("was"))
    counts = after.join(was, "id").groupBy("item_id").agg(F.count_if((F.col("was") == "queued") & (F.col("status") == "cancelled")).alias("cancelled"), F.count_if(F.col("status") == "queued").alias("queued"))
    return counts.join(reset.select(F.col("id").alias("item_id"), F.col("status").alias("item_status")), "item_id")


@query(JOBS_SQL + """
SELECT 'doc-' || doc_id AS item_id, 'index_document' AS job_type, 'discovered' AS status FROM documents WHERE doc_id % 4 = 0 AND source = (SELECT min(source) FROM documents) AND doc_id % 3 <> 0""")
def retried_items(spark, sf_dir):
    """Failed documents of one source are reset and planned again, but for those that are already at work."""
    first = A.table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    items = A.document_items(spark, sf_dir).withColumn("status", F.when(_number() % 4 == 0, "failed").otherwise("indexed"))
    active = items.where(_number() % 3 == 0).select(F.col("id").alias("item_id"), F.lit("index_document").alias("job_type"), F.lit("running").alias("status"))
    chunks = A.document_chunks(spark, sf_dir)
    reset, jobs, _ = I.retry_failed(items, active, {"units": chunks}, first)
    return jobs.select("item_id", "job_type").join(reset.select(F.col("id").alias("item_id"), "status"), "item_id")


@query("""
SELECT CASE WHEN doc_id % 4 = 0 THEN 'cleared' ELSE 'kept' END AS state, count(*) AS items, count(*) FILTER (doc_id % 4 <> 0) AS rows FROM documents GROUP BY 1""")
def retry_clears_rows(spark, sf_dir):
    """Units of items that are tried again are gone, those of others stay."""
    items = A.document_items(spark, sf_dir).withColumn("status", F.when(_number() % 4 == 0, "failed").otherwise("indexed"))
    none = items.where("false").select(F.col("id").alias("item_id"), F.lit("").alias("job_type"), F.lit("").alias("status"))
    _, _, tables = I.retry_failed(items, none, {"units": A.document_chunks(spark, sf_dir)})
    left = tables["units"].groupBy("item_id").agg(F.count("*").alias("n"))
    state = F.when(_number() % 4 == 0, "cleared").otherwise("kept")
    return items.join(left, F.col("id") == F.col("item_id"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query(JOBS_SQL + f""",
d AS (SELECT user_id, max(finished_at) FILTER (status = 'completed') AS done, max(started_at) AS indexed_at FROM f GROUP BY user_id)
SELECT 'u-' || user_id AS id, CASE WHEN user_id % 4 = 0 THEN 'indexed' ELSE 'failed' END AS status,
       CASE WHEN user_id % 8 = 0 THEN coalesce(done, {NOW}) ELSE indexed_at END::BIGINT AS indexed_at FROM d WHERE user_id % 8 = 0 OR user_id % 8 <> 0""")
def repaired_items(spark, sf_dir):
    """Items whose artifacts say that they are indexed."""
    n = _number()
    items = A.job_items(spark, sf_dir).withColumns({"status": F.lit("failed"), "indexed_at": F.when(n % 8 != 0, F.col("indexed_at")), "metadata": F.when(n % 4 == 0, '{"artifacts":{"status":"indexed"}}')})
    return I.repair_item_status(items, A.jobs(spark, sf_dir), NOW).select("id", "status", F.col("indexed_at").cast("long").alias("indexed_at"))


def _versioned(spark, sf_dir):
    """Documents with index versions, states and expected units that vary."""
    n = _number()
    return A.document_items(spark, sf_dir).withColumns({
        "status": _pick(n, "indexed", "processing", "discovered", "failed", "deleting"), "search_index_version": F.when(n % 3 == 0, 2).when(n % 3 == 1, 1), "search_index_status": _pick(n, "indexed", "pending", "failed", "indexed"),
        "search_index_unit_count": n % 2, "error": F.when(n % 5 == 3, F.concat(F.lit("open /Users/u"), (n % 9).cast("string"), F.lit("/media/a.mp4 failed"))), "discovered_at": F.lit(NOW),
    })


VERSIONED_SQL = f"""
WITH v AS (SELECT doc_id, 'doc-' || doc_id AS id, text, 1700000000 + doc_id AS indexed_at, {_sql_pick("doc_id", "indexed", "processing", "discovered", "failed", "deleting")} AS status, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS version,
                  {_sql_pick("doc_id", "indexed", "pending", "failed", "indexed")} AS search_status, doc_id % 2 AS expected, CASE WHEN doc_id % 5 = 3 THEN 'open /Users/u' || doc_id % 9 || '/media/a.mp4 failed' END AS error FROM documents)
"""


@query(VERSIONED_SQL + "SELECT id FROM v WHERE (coalesce(version, 0) < 2 OR search_status <> 'indexed') AND status <> 'deleting'")
def items_to_rebuild(spark, sf_dir):
    return I.items_needing_rebuild(_versioned(spark, sf_dir)).select("id")


def _health(spark, sf_dir):
    units = A.document_chunks(spark, sf_dir).select("id", "item_id", F.when(_number("item_id") % 6 == 0, "image").otherwise("document").alias("unit_kind")).where(_number("item_id") % 3 != 0)
    return I.index_health(_versioned(spark, sf_dir), A.document_chunks(spark, sf_dir), units, A.unit_vectors(spark, sf_dir), A.jobs(spark, sf_dir))


HEALTH_SQL = VERSIONED_SQL + """,
j AS (SELECT 'u-' || user_id AS item_id, event_type FROM events),
h AS (SELECT count(*) AS items, count(*) FILTER (status = 'indexed') AS items_indexed, count(*) FILTER (status = 'processing') AS items_processing, count(*) FILTER (status = 'discovered') AS items_discovered, count(*) FILTER (status = 'failed') AS items_failed,
             count(*) FILTER (status = 'deleting') AS items_deleting, count(*) FILTER (search_status = 'indexed') AS search_indexed, count(*) FILTER (search_status = 'pending') AS search_pending, count(*) FILTER (search_status = 'failed') AS search_failed,
             coalesce(sum(expected), 0)::BIGINT AS expected_units, count(*) AS chunks, 0::BIGINT AS frames, count(*) FILTER (text IS NULL) AS chunks_without_text, count(*) FILTER (doc_id % 3 <> 0) AS units, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 6 = 0) AS image_units,
             (SELECT count(*) FROM embeddings) AS points, (SELECT count(*) FROM embeddings) AS units_with_points, (SELECT count(*) FROM j WHERE event_type = 'click') AS jobs_running, (SELECT count(*) FROM j WHERE event_type = 'purchase') AS jobs_queued,
             (SELECT count(*) FROM j WHERE event_type = 'error') AS jobs_failed, (SELECT count(*) FROM j) AS orphan_jobs FROM v)
"""


@query(HEALTH_SQL + "SELECT *, greatest(units - points, 0) AS embedding_gap, expected_units > units AS drift, CASE WHEN expected_units > units THEN 'index_drift' WHEN units > points THEN 'embedding_gap' WHEN search_failed > 0 THEN 'index_failed' END AS error_code FROM h")
def index_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query(HEALTH_SQL + "SELECT CASE WHEN units > 0 AND points > 0 THEN 'hybrid' WHEN units > 0 THEN 'text' WHEN points > 0 THEN 'vector' ELSE 'empty' END AS mode, units > 0 AS text_ready, points > 0 AS vectors_ready, jobs_running + jobs_queued > 0 OR search_pending > 0 AS index_settling FROM h")
def library_status(spark, sf_dir):
    return I.library_status(_health(spark, sf_dir))


@query(VERSIONED_SQL + """,
p AS (SELECT 'job' AS kind, 'job-' || event_id AS id, floor(epoch(ts))::BIGINT + 60 AS "at", 'yt-dlp: HTTP Error ' || (400 + event_id % 30) AS error FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'item', id, indexed_at, '~/media/a.mp4 failed' FROM v WHERE error IS NOT NULL)
SELECT kind, id, p."at", CASE kind WHEN 'item' THEN 'open ' || error ELSE error END AS error FROM p ORDER BY p."at" DESC, kind, id LIMIT 20""")
def recent_problems(spark, sf_dir):
    return I.recent_problems(A.jobs(spark, sf_dir), _versioned(spark, sf_dir)).withColumn("at", F.col("at").cast("long"))


@query("""
WITH i AS (SELECT source, doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 4 = 0 THEN '/old/' || doc_id END AS raw_path FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT source, doc_id::VARCHAR AS external_id, '/library/' || doc_id || '.txt' AS raw_path FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(r.source, i.source) AS source_id, coalesce(r.external_id, i.external_id) AS external_id, CASE WHEN r.external_id IS NULL THEN 1 ELSE 2 END::BIGINT AS ignored_at, CASE WHEN r.external_id IS NULL THEN 'old' ELSE 'removed' END AS reason, coalesce(i.raw_path, r.raw_path) AS raw_path
FROM i FULL JOIN r ON i.source = r.source AND i.external_id = r.external_id""")
def merged_tombstones(spark, sf_dir):
    items = A.document_items(spark, sf_dir)
    n = _number()
    known = items.where(n % 2 == 0).select("source_id", "external_id", F.lit(1).cast("long").alias("ignored_at"), F.lit("old").alias("reason"), F.when(n % 4 == 0, F.concat(F.lit("/old/"), "external_id")).alias("raw_path"))
    removed = items.where(n % 3 == 0).select("source_id", "external_id", "raw_path", F.lit(2).cast("long").alias("ignored_at"), F.lit("removed").alias("reason"))
    return I.tombstone_removed(known, removed)


@query(VERSIONED_SQL + "SELECT status, count(*) AS items, count(*) AS chunks FROM v WHERE status <> 'deleting' GROUP BY status")
def items_after_removal(spark, sf_dir):
    """Items that are being deleted go, with their chunks."""
    items, tables = I.remove_deleting_items(_versioned(spark, sf_dir), {"chunks": A.document_chunks(spark, sf_dir)})
    left = tables["chunks"].groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(left, F.col("id") == F.col("item_id"), "left").groupBy("status").agg(F.count("*").alias("items"), F.sum("n").alias("chunks"))


@query("SELECT t.case_, CASE t.case_ WHEN 'same' THEN 0 ELSE (SELECT count(*) FROM documents) END::BIGINT AS n FROM (VALUES ('same'), ('version'), ('backend')) AS t(case_)")
def schema_rebuilds(spark, sf_dir):
    """Items that are planned again when the stored version or backend differs."""
    items = A.document_items(spark, sf_dir)
    stored = {"same": (I.MODEL_INDEX_VERSION, "default"), "version": (I.MODEL_INDEX_VERSION - 1, "default"), "backend": (I.MODEL_INDEX_VERSION, "other")}
    out = None
    for name, row in stored.items():
        settings = spark.range(1).select(F.lit(row[0]).alias("index_version"), F.lit(row[1]).alias("backend"))
        one = I.schema_rebuild_plan(items, settings).agg(F.count("*").alias("n")).select(F.lit(name).alias("case_"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# F

def _media(spark, sf_dir):
    """Conversations as media with varied kinds, states, artifacts and lengths."""
    n = _number()
    status = _pick(n, "indexed", "failed", "processing", "indexed", "discovered")
    artifacts = F.when(n % 3 == 0, '{"artifacts":{"transcript":"indexed","ocr":"failed"},"display_title":" Shown "}').when(n % 3 == 1, '{"artifacts":{"understanding":"indexed"}}').otherwise("{bad")
    return A.media_items(spark, sf_dir).withColumns({"status": status, "indexed_at": F.when(n % 4 != 0, F.col("indexed_at")), "metadata": artifacts, "content_type": _pick(n, "video", "audio", "image"), "duration_sec": F.when(n % 6 != 0, F.col("duration_sec") * 20)})


MEDIA_SQL = f"""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, 'conv-' || conv_id AS id, 'Conversation ' || conv_id AS title, {_sql_pick("conv_id", "indexed", "failed", "processing", "indexed", "discovered")} AS status, CASE WHEN conv_id % 4 <> 0 THEN 1700000000 + conv_id END AS indexed_at,
             {_sql_pick("conv_id", "video", "audio", "image")} AS content_type, CASE WHEN conv_id % 6 <> 0 THEN 12.0::DOUBLE * n * 20 END AS duration_sec FROM c)
"""


@query(MEDIA_SQL + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS by, * FROM (SELECT id FROM m ORDER BY {order}, id LIMIT 15)" for name, order in (("recent", "indexed_at DESC NULLS LAST"), ("longest", "duration_sec DESC NULLS LAST"), ("shortest", "duration_sec NULLS LAST"), ("title", "lower(title)"))) + ")")
def sorted_library(spark, sf_dir):
    """The first fifteen items by each order."""
    out = None
    for by in ("recent", "longest", "shortest", "title"):
        one = LIB.sort_library(_media(spark, sf_dir), by).limit(15).select(F.lit(by).alias("by"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query(MEDIA_SQL + """SELECT id, CASE WHEN status = 'indexed' OR indexed_at IS NOT NULL OR conv_id % 3 IN (0, 1) THEN 'indexed' WHEN status = 'failed' THEN 'failed' ELSE 'indexing' END AS shown_status, conv_id % 3 = 0 AS partial, conv_id % 3 = 0 AS speech_searchable, conv_id % 3 = 1 AS visual_searchable FROM m""")
def derived_statuses(spark, sf_dir):
    return LIB.derive_item_status(_media(spark, sf_dir)).select("id", "shown_status", "partial", "speech_searchable", "visual_searchable")


TYPES = ("youtube", "rss_podcast", "folder_video", "file_video", "Web_Video", "notes")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'podcast' WHEN 2 THEN 'folder' WHEN 3 THEN 'file' WHEN 4 THEN 'web' ELSE 'other' END AS kind FROM events")
def source_kinds(spark, sf_dir):
    return A.table(spark, sf_dir, "events").withColumn("type", _pick(F.col("event_id"), *TYPES)).select("event_id", LIB.source_kind("type").alias("kind"))


@query(MEDIA_SQL + """,
p AS (SELECT conv_id, max(turn) * 7.5::DOUBLE AS position_sec, max(conv_id * 31 % 101) AS updated_at FROM conversations GROUP BY conv_id)
SELECT 'recent' AS shelf, id, NULL::DOUBLE AS seconds FROM (SELECT id FROM m WHERE status = 'indexed' ORDER BY indexed_at DESC NULLS LAST, id LIMIT 4)
UNION ALL SELECT 'continue', id, position_sec FROM (SELECT id, position_sec FROM m JOIN p USING (conv_id) WHERE content_type <> 'image' ORDER BY updated_at DESC, id LIMIT 3)
UNION ALL SELECT 'runtime', NULL, coalesce(sum(duration_sec), 0) FROM m""")
def home_shelves(spark, sf_dir):
    """Recently indexed items, items to go on with, and the total runtime."""
    items = _media(spark, sf_dir)
    turns = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") * 7.5).alias("position_sec"))
    positions = turns.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("item_id"), "position_sec", (F.col("conv_id") * 31 % 101).alias("updated_at"))
    recent = LIB.recently_indexed(items).select(F.lit("recent").alias("shelf"), "id", F.lit(None).cast("double").alias("seconds"))
    going = LIB.continue_watching(items, positions, 3).select(F.lit("continue"), "item_id", "position_sec")
    return recent.union(going).union(LIB.total_runtime(items).select(F.lit("runtime"), F.lit(None).cast("string"), "seconds"))


@query(MEDIA_SQL + f"SELECT id FROM m WHERE content_type = 'video' AND duration_sec / 60 >= 20 AND duration_sec / 60 < 60 AND contains(lower(title), 'n 1') AND ({NOW} - indexed_at) / 86400.0 > 30")
def filtered_library(spark, sf_dir):
    return LIB.filter_library(_media(spark, sf_dir), NOW, "N 1", content_type="video", duration="20_to_60", age="older").select("id")


def _moments(spark, sf_dir):
    """One moment for each turn: some without a quote, an item, a title or a time, some that name another item's chunk."""
    c = A.table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 10 + F.col("turn")
    conv = lambda c: F.concat(F.lit("conv-"), c.cast("string"))
    chunk = F.concat(conv(F.col("conv_id") + F.when(n % 5 == 0, 1).otherwise(0)), F.lit(":transcript:"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    return c.select(
        F.concat(F.lit("m-"), n.cast("string")).alias("id"), F.when(n % 11 == 0, "gone").otherwise(conv(F.col("conv_id"))).alias("item_id"), F.when(n % 3 != 0, chunk).alias("chunk_id"), F.when(n % 4 != 0, 12.0 * F.col("turn")).alias("start_sec"),
        F.when(n % 2 == 0, F.concat(F.lit("Title "), n.cast("string"))).otherwise(F.lit("  ")).alias("title"), F.when(n % 7 == 0, " ").otherwise(F.concat(F.lit("quote "), n.cast("string"))).alias("quote"), F.when(n % 6 == 0, "a note").alias("note"), n.alias("created_at"),
    )


MOMENTS_SQL = """
WITH o AS (SELECT conv_id * 10 + turn AS n, conv_id, turn FROM conversations),
k AS (SELECT o.*, n % 11 = 0 AS lost, EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = o.conv_id AND x.turn = o.turn) AS there FROM o),
m AS (SELECT *, n % 7 <> 0 AND NOT lost AND (n % 3 = 0 OR n % 5 <> 0) AS good, CASE WHEN n % 2 = 0 THEN 'Title ' || n WHEN lost THEN 'Untitled' ELSE 'Conversation ' || conv_id END AS title,
             CASE WHEN n % 4 <> 0 THEN printf('%d:%02d', (12 * turn) // 60, (12 * turn) % 60) END AS label FROM k)
"""


@query(MOMENTS_SQL + """
SELECT 'm-' || n AS id, good, '## ' || title || coalesce(' (' || label || ')', '') || E'\\n\\n> ' || CASE WHEN n % 7 = 0 THEN ' ' ELSE 'quote ' || n END || CASE WHEN n % 6 = 0 THEN E'\\n\\na note' ELSE '' END AS markdown,
       '“' || CASE WHEN n % 7 = 0 THEN ' ' ELSE 'quote ' || n END || '” — ' || title || coalesce(' (' || label || ')', '') AS citation FROM m""")
def moments_checked(spark, sf_dir):
    """Moments with titles, as Markdown and citations, and whether they are valid."""
    moments, items = _moments(spark, sf_dir), A.media_items(spark, sf_dir)
    good, bad = LIB.validate_moments(moments, items, A.media_chunks(spark, sf_dir))
    listed = LIB.list_moments(moments, items)
    texts = LIB.export_moments(listed).withColumnRenamed("text", "markdown").join(LIB.export_moments(listed, "citation").withColumnRenamed("text", "citation"), "id")
    return texts.join(good.select("id", F.lit(True).alias("good")).union(bad.select("id", F.lit(False))), "id").select("id", "good", "markdown", "citation")


@query("""
WITH t AS (SELECT conv_id, turn, conv_id * 100 + turn AS target, 12.0 * turn + CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 6 END AS at, CASE WHEN turn % 5 = 4 THEN 0 END AS wanted, CASE WHEN turn % 4 = 3 THEN '0:12' END AS label FROM conversations),
r AS (SELECT t.target, c.turn AS hit, row_number() OVER (PARTITION BY t.target ORDER BY CASE WHEN c.turn = t.wanted THEN 0 WHEN t.label = printf('%d:%02d', (12 * c.turn) // 60, (12 * c.turn) % 60) THEN 1 ELSE 2 END, abs(12.0 * c.turn - t.at), c.turn) AS n
      FROM t JOIN (SELECT DISTINCT conv_id, turn FROM conversations) c USING (conv_id))
SELECT target::VARCHAR AS target_id, hit AS turn FROM r WHERE n = 1""")
def chunks_at_times(spark, sf_dir):
    """For a time in every turn the row that was asked for, that a label names, or that is nearest."""
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    item = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    targets = c.select((F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("target_id"), item.alias("item_id"), (12.0 * F.col("turn") + F.when(F.col("turn") % 3 == 0, 1).when(F.col("turn") % 3 == 1, 7).otherwise(6)).alias("at"), F.when(F.col("turn") % 5 == 4, F.concat(item, F.lit(":transcript:000000"))).alias("preferred_id"), F.when(F.col("turn") % 4 == 3, "0:12").alias("label"))
    found = LIB.nearest_chunk_for_time(targets, A.media_chunks(spark, sf_dir).where("chunk_type = 'transcript'"))
    return found.select("target_id", F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long").alias("turn"))


# G

LABELS_SQL = r"""
WITH w AS (SELECT conv_id, turn, regexp_extract(text, '^\S+(\s+\S+)?') AS raw FROM conversations),
t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(raw, '^[^\p{L}\p{N} -]+|[^\p{L}\p{N} -]+$', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS label FROM w),
l AS (SELECT conv_id, turn, label, regexp_replace(regexp_replace(lower(label), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS entity, CASE WHEN regexp_matches(label, '^[A-Z]') THEN 'person_or_entity' ELSE 'topic' END AS kind
      FROM t WHERE strlen(label) BETWEEN 3 AND 80 AND lower(label) NOT IN ('the', 'and', 'this', 'that', 'with', 'from', 'your', 'you')),
e AS (SELECT * FROM l WHERE entity <> '')
"""


def _topics(spark, sf_dir):
    """The first two words of every turn as topics of its conversation."""
    c = A.table(spark, sf_dir, "conversations").withColumn("label", F.regexp_extract("text", r"^\S+(\s+\S+)?", 0))
    listed = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "label"))), lambda s: s["label"]).alias("topics"))
    told = listed.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("item_id"), F.to_json(F.struct("topics")).alias("result"))
    return G.entity_mentions(A.media_items(spark, sf_dir), told, A.media_chunks(spark, sf_dir).where("false"))


@query(LABELS_SQL + "SELECT entity, min(kind) AS kind, count(*) AS mentions, count(DISTINCT conv_id) AS items FROM (SELECT DISTINCT entity, conv_id, kind FROM e) GROUP BY entity HAVING count(DISTINCT kind) = 1")
def topic_summary(spark, sf_dir):
    """Entities of all topics, each once an item, with how many items name them; those that are always of one kind."""
    first = G.dedupe_mentions(_topics(spark, sf_dir))
    mixed = _topics(spark, sf_dir).groupBy("entity").agg(F.count_distinct("kind").alias("kinds")).where("kinds > 1")
    return G.entity_summary(first, None).join(mixed, "entity", "left_anti").select("entity", "kind", "mentions", "items")


PHRASES_SQL = ", ".join(f"'{p}'" for p in G.PHRASES)


@query(rf"""
WITH d AS (SELECT doc_id, text || ' Deep Test Bench. The Media Memory ' || source AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}''-]'), lambda w: strlen(w) > 1) AS ws FROM d),
r AS (SELECT doc_id, list_concat(list_filter([{PHRASES_SQL}], lambda p: contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p)),
             regexp_extract_all(array_to_string(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '^[A-Z]') AND w NOT IN ('I', 'The', 'This', 'That', 'And', 'But') THEN w ELSE chr(10) END), ' '), '[^ \n]+(?: [^ \n]+){{1,3}}')) AS labels FROM w),
l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(unnest(labels), '^[^\p{{L}}\p{{N}} -]+|[^\p{{L}}\p{{N}} -]+$', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS label FROM r),
e AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(lower(label), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS entity FROM l WHERE strlen(label) BETWEEN 3 AND 80 AND lower(label) NOT IN ('the', 'and', 'this', 'that', 'with', 'from', 'your', 'you'))
SELECT entity, count(*) AS mentions, count(*) AS items FROM e WHERE entity <> '' GROUP BY entity""")
def document_entities(spark, sf_dir):
    """All entities that whole documents name (with a line of known ones added to each)."""
    none = spark.createDataFrame([], "item_id string, result string")
    chunks = A.document_chunks(spark, sf_dir).join(A.document_items(spark, sf_dir).select(F.col("id").alias("item_id"), "source_id"), "item_id")
    chunks = chunks.withColumn("text", F.concat("text", F.lit(" Deep Test Bench. The Media Memory "), "source_id"))
    mentions = G.dedupe_mentions(G.entity_mentions(A.document_items(spark, sf_dir), none, chunks))
    return G.entity_summary(mentions, None).select("entity", "mentions", "items")


@query(LABELS_SQL + """,
i AS (SELECT conv_id, 12.0 * count(*) AS d, max(turn) * 7.5 AS p FROM conversations GROUP BY conv_id),
k AS (SELECT * FROM i WHERE 1700000000 + conv_id <= 1700000050 AND 1700000000 + conv_id >= 1700000050 - 7 * 86400)
SELECT count(*) AS n_items, sum(d)::DOUBLE AS seconds, least(greatest(round(100 * sum(least(p, d)) / sum(d)), 0), 100)::INT AS watched_percent FROM k""")
def weekly_review(spark, sf_dir):
    turns = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") * 7.5).alias("position_sec"))
    positions = turns.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("item_id"), "position_sec")
    return G.weekly_review(A.media_items(spark, sf_dir), positions, _topics(spark, sf_dir), 1_700_000_050).select("n_items", "seconds", "watched_percent")


# J

RELEVANCE_SQL = """
WITH r AS (SELECT d.source AS q, d.doc_id, l.quality + l.toxic AS grade, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT q, count(*) AS relevant FROM r WHERE grade > 0 GROUP BY q),
i AS (SELECT q, sum((2 ** grade - 1) / log2(n + 1)) AS ideal FROM (SELECT q, grade, row_number() OVER (PARTITION BY q ORDER BY grade DESC) AS n FROM r WHERE grade > 0) WHERE n <= 10 GROUP BY q),
h AS (SELECT q, count(*) AS hits, sum((2 ** grade - 1) / log2(rank + 1)) AS gain, min(rank) AS first, max(CASE WHEN abs(rank - doc_id % 12) <= 5 THEN 1 ELSE 0 END) AS moment FROM r WHERE grade > 0 AND rank <= 10 GROUP BY q),
a AS (SELECT 'length ' || substr(g.q, -1) AS query_type, coalesce(hits / relevant, 0) AS recall, coalesce(hits / 10.0, 0) AS "precision", coalesce(gain / ideal, 0) AS ndcg, coalesce(1.0 / first, 0) AS mrr, moment FROM g JOIN i USING (q) LEFT JOIN h USING (q))
"""


def _relevance(spark, sf_dir):
    both = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = both.select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), rank.alias("rank"), rank.cast("double").alias("start_sec"))
    at = (F.col("doc_id") % 12).cast("double")
    truth = both.select(F.col("source").alias("query_id"), F.concat(F.lit("length "), F.substr("source", F.lit(-1), F.lit(1))).alias("query_type"), F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("grade"), at.alias("start_sec"), at.alias("end_sec"))
    return J.relevance_eval(ranked, truth)


@query(RELEVANCE_SQL + """SELECT query_type, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(moment), 6) AS moment_accuracy FROM a GROUP BY query_type""")
def graded_relevance(spark, sf_dir):
    """All measures of relevance, with two grades and times, by kind of query."""
    return _relevance(spark, sf_dir).select("query_type", "queries", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "mrr", "moment_accuracy")])


@query(RELEVANCE_SQL + ", t AS (SELECT query_type, avg(ndcg) AS ndcg, avg(mrr) AS mrr FROM a GROUP BY query_type) SELECT bool_and(ndcg >= mrr) AS passed, TRUE AS same_passed FROM t")
def quality_gates(spark, sf_dir):
    """A baseline that asks for as much as the first hit tells, and the run itself as its baseline."""
    now = _relevance(spark, sf_dir)
    gate = J.quality_gate(now.select("query_type", "ndcg"), now.select("query_type", F.col("mrr").alias("ndcg")))
    return gate.join(J.quality_gate(now, now).withColumnRenamed("passed", "same_passed"))  # one row each
