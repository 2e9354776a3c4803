"""Whole searches on a small index."""

from pyspark.sql import functions as F

from vidimus import schemas as S
from vidimus.operators import jobs as I
from vidimus.operators import ranking as R
from vidimus.operators import units as C
from vidimus.operators import vectors as V
from vidimus.plans import search


def index(spark):
    texts = {"a": "alpha beta launch plan", "b": "gamma delta budget review", "c": "alpha notes", "d": "unrelated words here"}
    items = spark.createDataFrame([(f"i-{k}", "s", "document", f"Doc {k}", None, "/x", 5, "indexed", 2, "failed" if k == "d" else "indexed") for k in texts], "id string, source_id string, content_type string, title string, duration_sec double, raw_path string, indexed_at long, status string, search_index_version int, search_index_status string")
    rows = spark.createDataFrame([(f"c-{k}", f"i-{k}", "document", None, None, t, None, None) for k, t in texts.items()], S.CHUNKS)
    named = items.select("id", F.col("title").alias("item_title"), F.col("source_id").alias("source_label"))
    units = C.build_document_units(named, rows)
    vectors = V.embed(V.plan_embeddings(units), lambda: V.hashing_embedder(32))
    return items, rows, units, vectors


def test_hybrid_search(spark):
    items, chunks, units, vectors = index(spark)
    embed = V.hashing_embedder(32)
    asked = [(1, "alpha beta", 10), (2, "budget", 5), (3, "unrelated", 5), (4, "nothing at all", 5)]
    queries = spark.createDataFrame([(n, q, k, "smart", [float(x) for x in embed([q])[0]], "en") for n, q, k in asked], "query_id int, q string, limit int, preference string, query_vector array<float>, locale string")
    got = search.hybrid_search(queries, units, items, vectors.where("item_id <> 'i-d'")).collect()
    best = {r.query_id: r for r in got if r["rank"] == 1}
    assert best[1].item_id == "i-a" and best[1].exact_match and best[1].has_vector and 0.92 <= best[1].match_score <= 0.98
    assert best[2].item_id == "i-b" and "budget" in best[2].snippet
    assert all(r.item_id != "i-d" for r in got)
    ranks = {}
    for r in got:
        ranks.setdefault(r.query_id, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
    plain = search.lexical_fallback_search(queries.withColumn("query_vector", F.lit(None).cast("array<float>")), units, items).collect()
    assert {(r.query_id, r.item_id) for r in plain} == {(1, "i-a"), (2, "i-b")}
    old = search.legacy_chunk_search(queries, chunks, items.withColumn("search_index_version", F.lit(1))).collect()
    assert {(r.query_id, r.item_id) for r in old} == {(1, "i-a"), (2, "i-b"), (3, "i-d")}
    counts = {r.query_id: (r["mode"], r.n_lexical) for r in R.search_diagnostics(queries, spark.createDataFrame([(1, "u")], "query_id int, unit_id string"), spark.createDataFrame([], "query_id int, unit_id string"), True).collect()}
    assert counts == {1: ("hybrid", 1), 2: ("hybrid", 0), 3: ("hybrid", 0), 4: ("hybrid", 0)}


def test_index_health(spark):
    items, chunks, units, vectors = index(spark)
    items = items.withColumn("search_index_unit_count", F.lit(2).cast("long"))
    jobs = spark.createDataFrame([("1", "i-a", "index_document", "running")], "id string, item_id string, job_type string, status string")
    health = I.index_health(items, chunks, units, vectors.limit(3), jobs)
    row = health.first()
    assert (row["items"], row["units"], row["points"], row.embedding_gap, row.drift, row.error_code) == (4, 4, 3, 1, True, "index_drift")
    status = I.library_status(health).first()
    assert status["mode"] == "hybrid" and status.index_settling and not I.library_status(health, paused=True).first().index_settling


def test_search_carries_evidence(spark):
    """A hit plays from the line or the on-screen row that answers, with the nearest frame; old chunks join before the ranking."""
    items = spark.createDataFrame([(k, "s", "video", f"Talk {k}", 100.0, f"/{k}", 5, "indexed", v, "indexed") for k, v in (("new", 2), ("old", 1))], "id string, source_id string, content_type string, title string, duration_sec double, raw_path string, indexed_at long, status string, search_index_version int, search_index_status string")
    row = lambda item, n, kind, start, end, text, frame=None: (f"{item}:{kind}:{n}", item, kind, start, end, text, frame, None)
    chunks = [row("new", k, "transcript_line", 2.0 * k, 2.0 * k + 2, t) for k, t in enumerate(["database overview", "nothing here", "database settings open the config panel", "more of it"])]
    chunks += [row("new", 9, "transcript", 0.0, 8.0, "database overview nothing here database settings open the config panel more of it")]
    chunks += [row("new", k, "keyframe", 5.0 * k, 5.0 * k + 5, None, f"f{k}.jpg") for k in range(3)] + [row("new", 0, "ocr", None, None, "quarterly chart", "f2.jpg")]
    chunks += [row("old", 0, "transcript", 3.0, 6.0, "the database config of old"), row("old", 0, "keyframe", 4.0, 5.0, None, "g.jpg"), row("old", 1, "keyframe", 61.0, 62.0, None, "h.jpg"), row("old", 1, "ocr", 40.0, 41.0, "quarterly database"), row("old", 0, "understanding", 60.0, 70.0, "told database config")]
    chunks = spark.createDataFrame(chunks, S.CHUNKS)
    named = items.select("id", F.col("title").alias("item_title"), F.lit("s").alias("source_label"))
    units = C.build_timed_units(named.where("id = 'new'"), chunks.where("item_id = 'new'"))
    queries = spark.createDataFrame([(1, "database config", 10), (2, "quarterly chart", 10)], "query_id int, q string, limit int").withColumns({"preference": F.lit("smart"), "query_vector": F.lit(None).cast("array<float>"), "locale": F.lit("en")})
    got = {}
    for r in search.lexical_fallback_search(queries, units, items, chunks).collect():
        got.setdefault((r.query_id, r.item_id), []).append(r)
    line = got[1, "new"][0]
    assert (line.playback_chunk_id, line.chunk_type, line.start_sec, line.frame_id) == ("new:transcript_line:2", "transcript_line", 4.0, "new:keyframe:1")
    shown = got[2, "new"][0]
    assert (shown.playback_chunk_id, shown.chunk_type, shown.start_sec, shown.snippet) == ("new:ocr:0", "ocr", 10.0, "quarterly chart")
    old = {r.playback_chunk_id: r for r in got[1, "old"]}
    assert old["old:transcript:0"].snippet == "the database config of old" and old["old:transcript:0"].frame_id == "old:keyframe:0" and old["old:transcript:0"].exact_match
    assert old["old:understanding:0"].snippet == "Video understanding at 1:01"  # it starts with the nearest frame
