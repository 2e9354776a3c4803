"""Literal cases and seeded random checks of the evidence library."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from vidimus import schemas as S
from vidimus.functions import text as T
from vidimus.operators import ann as A
from vidimus.operators import chunks as B
from vidimus.operators import entities as G
from vidimus.operators import evidence as E
from vidimus.operators import jobs as I
from vidimus.operators import lexical as L
from vidimus.operators import library as LIB
from vidimus.operators import quality as J
from vidimus.operators import ranking as R
from vidimus.operators import units as C
from vidimus.operators import usage as H
from vidimus.operators import vectors as V
from vidimus.sources import discovery, feeds, files, urls
from vidimus.streaming import streams


def segments(spark, n, item="a", size=5.0):
    return spark.createDataFrame([(item, size * k, size * (k + 1), f"segment-{k}") for k in range(n)], "item_id string, start_sec double, end_sec double, text string")


@pytest.mark.parametrize(("n", "windows"), [(12, 3), (120, 24), (1, 1), (0, 0)])
def test_transcript_windows(spark, n, windows):
    got = B.transcript_windows(segments(spark, n, size=5.0 if n > 1 else 600.0), 30, 5).orderBy("k").collect()
    assert len(got) == windows
    if n == 12:
        assert (got[0].start_sec, got[0].end_sec, got[0].text.split()) == (0, 30, [f"segment-{k}" for k in range(6)])
        assert (got[1].start_sec, got[1].end_sec, got[1].text.split()) == (25, 55, [f"segment-{k}" for k in range(5, 11)])
    if n == 120:
        assert got[-1].end_sec == 600 and all(r.end_sec - r.start_sec <= 30 for r in got)
    if n == 1:
        assert (got[0].start_sec, got[0].end_sec) == (0, 600)


def naive_overlap(ls, le, rs, re):
    if ls is None or rs is None:
        return True
    if le is not None and re is not None:
        return rs <= ls <= re if le == ls else ls < re and le > rs
    if re is not None:
        return rs <= ls <= re
    return le >= rs and ls <= rs if le is not None else abs(ls - rs) < 30


def test_interval_join_equals_naive_loop(spark):
    rng = random.Random(1)
    rows, windows = [], []
    for item in range(40):
        for k in range(rng.randint(0, 30)):
            s = None if rng.random() < 0.05 else round(rng.uniform(0, 400), 1)
            e = None if rng.random() < 0.1 or s is None else s + rng.choice([0, 0, 1, 10, 45, 9000])
            rows.append((f"i{item}", f"i{item}-{k}", s, e))
        for k in range(rng.randint(0, 15)):
            s = None if rng.random() < 0.05 else round(rng.uniform(0, 400), 1)
            windows.append((f"i{item}", k, s, None if rng.random() < 0.1 or s is None else s + rng.choice([0.5, 30, 100, 8000])))
    a = spark.createDataFrame(rows, "item_id string, id string, eff_start double, eff_end double")
    b = spark.createDataFrame(windows, "item_id string, k int, window_start double, window_end double")
    joined = C.interval_overlap_join(a, b)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    got = sorted((r.id, r.k) for r in joined.collect())
    assert got == sorted((i, k) for t, i, s, e in rows for w, k, ws, we in windows if t == w and naive_overlap(s, e, ws, we))


@pytest.mark.parametrize("following", [False, True])
def test_nearest_frame_equals_naive_loop(spark, following):
    rng = random.Random(2)
    frames = [(f"i{i}", f"i{i}-f{k:02}", float(t), None) for i in range(20) for k, t in enumerate(sorted(rng.sample(range(60), rng.randint(1, 12))))]
    targets = [(f"i{i}", f"{i}-{k}", float(rng.choice(range(60))) if k else None) for i in range(20) for k in range(10)]
    got = {r.target_id: r.frame_id for r in C.nearest_frame_asof(spark.createDataFrame(targets, "item_id string, target_id string, at double"), spark.createDataFrame(frames, "item_id string, id string, start_sec double, frame_path string"), following).collect()}
    for item, t, at in targets:
        own = [f for f in frames if f[0] == item]
        want = own[0] if at is None else min(own, key=lambda f: (abs(f[2] - at), -f[2] if following else f[2]))
        assert got[t] == want[1]


def chunk(item, id, kind, start=None, end=None, text=None, path=None, meta=None):
    return (id, item, kind, start, end, text, path, json.dumps(meta) if meta else None)


def units_of(spark, rows, title="Title"):
    items = spark.createDataFrame([(i, title, "src") for i in sorted({r[1] for r in rows})], "id string, item_title string, source_label string")
    return C.build_timed_units(items, spark.createDataFrame(rows, S.CHUNKS)).orderBy("item_id", "unit_index").collect()


def test_timed_units(spark):
    rows = [
        chunk("a", "a1", "transcript", 0.0, 12.0, "alpha"), chunk("a", "a2", "transcript", 15.0, 28.0, "beta"),
        chunk("b", "b1", "understanding", 205.0, 327.0, "chapter text", meta={"kind": "chapter"}), chunk("b", "b2", "understanding", 205.0, 327.0, "event text", meta={"kind": "event"}),
        chunk("c", "c1", "transcript", 0.0, 10.0, "spoken"), chunk("c", "c2", "keyframe", 100.0, 105.0, path="f.jpg"),
        chunk("d", "d1", "transcript", 35.0, 45.0, "spoken"), chunk("d", "d2", "keyframe", 0.0, 5.0, path="g.jpg"),
        chunk("e", "e1", "understanding", None, None, "all about it", meta={"kind": "summary"}), chunk("e", "e2", "ocr", None, None, "on screen", path="h.jpg"), chunk("e", "e3", "keyframe", 10.0, 20.0, path="h.jpg"),
    ]
    got = {}
    for r in units_of(spark, rows):
        got.setdefault(r.item_id, []).append(r)
    assert len(got["a"]) == 1 and "alpha beta" in got["a"][0].content_text and got["a"][0].content_text.startswith("Title: Title\nSource: src\nTime: 0.0s-28.0s")
    assert [(r.unit_kind, r.visual_text) for r in got["b"]] == [("moment", "event text")]
    assert [r.unit_kind for r in got["c"]] == ["moment", "image"] and got["c"][1].representative_frame_path == "f.jpg"
    assert sorted(r.unit_kind for r in got["d"]) == ["image", "moment"] and len({r.id for r in got["d"]}) == 2
    assert [(r.unit_kind, r.ocr_text, r.summary_text) for r in got["e"]] == [("summary", None, "all about it"), ("moment", "on screen", None)] and got["e"][0].representative_chunk_id == "e3"


HITS = "query_id int, unit_id string, item_id string, playback_chunk_id string, chunk_type string, item_content_type string, start_sec double, score double, similarity double, exact_match boolean, has_text boolean, has_vector boolean, preference string, rank int"


def hit(id, item="item-1", start=None, kind="transcript", score=0.5, sim=None, exact=False, text=True, vec=False, rank=1, query=1):
    return (query, id, item, id, kind, None, start, score, sim, exact, text, vec, "smart", rank)


def test_scores_and_ranks(spark):
    rows = [hit("vector", score=0.97, sim=0.97, text=False, vec=True), hit("lexical", score=0.40), hit("exact", score=0.01, exact=True)]
    got = R.with_rank(R.with_match_scores(spark.createDataFrame(rows, HITS).drop("rank"))).orderBy("rank").collect()
    assert [(r.unit_id, round(r.match_score, 3)) for r in got] == [("exact", 0.92), ("vector", 0.91), ("lexical", 0.79)]
    rows = [hit("a", score=0.012, query=2), hit("b", score=0.006, query=2), hit("c", score=0.41, sim=0.41, text=False, vec=True, query=3)]
    got = {r.unit_id: round(r.match_score, 4) for r in R.with_match_scores(spark.createDataFrame(rows, HITS)).collect()}
    assert got == {"a": 0.79, "b": 0.41, "c": 0.2665}


def greedy(rows):
    kept = []
    for r in rows:
        for k in kept:
            if k[0][2] == r[2] and (k[0][3] == r[3] or (not (k[0][4] == r[4] == "document") and (abs(k[0][6] - r[6]) < 30 if k[0][6] is not None and r[6] is not None else k[0][4] == r[4]))):
                k[1] += 1
                break
        else:
            if sum(k[0][2] == r[2] for k in kept) < 3:
                kept.append([r, 0])
    return {(k[0][0], k[0][1]): k[1] for k in kept}


def test_collapse(spark):
    rows = [hit("1", start=10.0, rank=1), hit("2", start=25.0, rank=2), hit("3", start=90.0, rank=3), hit("4", "item-2", 12.0, rank=4)]
    assert {r.unit_id for r in R.collapse_near_duplicates(spark.createDataFrame(rows, HITS)).collect()} == {"1", "3", "4"}
    rows = [hit("1", start=10.0, rank=1), hit("2", start=90.0, rank=2), hit("3", start=150.0, rank=3), hit("4", start=18.0, score=0.72, sim=0.72, text=False, vec=True, rank=4)]
    got = {r.unit_id: r for r in R.collapse_near_duplicates(spark.createDataFrame(rows, HITS)).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].has_vector and got["1"].score == 0.72
    assert R.collapse_near_duplicates(spark.createDataFrame([hit("1", kind="document"), hit("2", kind="document", rank=2)], HITS)).count() == 2
    rng = random.Random(3)
    rows = [hit(f"u{k}", f"i{rng.randint(0, 4)}", rng.choice([None, float(rng.randint(0, 200))]), rng.choice(["transcript", "ocr", "document"]), rank=k + 1, query=q) for q in range(15) for k in range(40)]
    got = {(r.query_id, r.unit_id): r.n_merged for r in R.collapse_near_duplicates(spark.createDataFrame(rows, HITS)).collect()}
    want = {}
    for q in range(15):
        want |= greedy([r for r in rows if r[0] == q])
    assert got == want


def test_query_columns(spark):
    frame = spark.createDataFrame([("eclipse roadmap",), ("video clip roadmap",), ('"short"',), ("PX-1000",), ("地下室光源",), ("地下室",), ("ai",)], "q string")
    got = {r.q: (r.p, r.e) for r in frame.select("q", T.inferred_preference("q").alias("p"), T.strong_exact_intent("q").alias("e")).collect()}
    assert got["eclipse roadmap"][0] == "smart" and got["video clip roadmap"][0] == "video"
    assert [got[q][1] for q in ('"short"', "PX-1000", "地下室光源", "地下室", "ai")] == [True, True, True, False, False]
    d = [r[0] for r in spark.createDataFrame([(0.0,), (0.92,), (1.25,)], "d double").select(T.from_distance(F.col("d"))).collect()]
    assert [round(x, 6) for x in d] == [1.0, 0.08, 0.0]
    assert spark.range(1).select(T.clock(F.lit(3725.9)), T.clock(F.lit(65.6), True), T.seconds_of(F.lit("1:02:05")), T.slug(F.lit(" Ä-b c! "))).first() == ("1:02:05", "1:06", 3725.0, "ä-b-c")


def test_best_spoken_line(spark):
    rows = [chunk("i", "1", "transcript_line", 1.0, 2.0, "database overview"), chunk("i", "2", "transcript_line", 20.0, 21.0, "database settings open the config panel")]
    hits = spark.createDataFrame([(1, "u", "i", "database config", 0.0, 30.0)], "query_id int, unit_id string, item_id string, q string, start_sec double, end_sec double")
    got = R.best_spoken_line(hits, spark.createDataFrame(rows, S.CHUNKS)).first()
    assert (got.spoken_id, got.spoken_start) == ("2", 20.0)


def test_lexical(spark):
    units = spark.createDataFrame([("1", "alpha beta gamma"), ("2", "beta alpha PX-1000 x"), ("3", "nothing 50% here"), ("4", "px 1000 alpha beta")], "id string, content_text string").withColumn("unit_kind", F.lit("moment")).withColumn("start_sec", F.lit(0.0))
    queries = spark.createDataFrame([(1, "alpha beta", 10), (2, "PX-1000", 10), (3, "50% h", 10), (4, "  ", 10), (5, '"alpha beta"', 10)], "query_id int, q string, limit int")
    words = {(r.query_id, r.unit_id) for r in L.bm25_search(queries, units).collect()}
    assert words == {(1, "1"), (1, "2"), (1, "4"), (2, "2"), (2, "4"), (5, "1"), (5, "2"), (5, "4")}
    literal = {(r.query_id, r.unit_id, r.exact_match) for r in L.literal_search(queries, units).collect()}
    assert literal == {(1, "1", True), (1, "4", True), (2, "2", True), (3, "3", True)}
    both = L.lexical_candidates(queries, units).where("query_id = 2").collect()
    assert {(r.unit_id, r.exact_match) for r in both} == {("2", True), ("4", False)}


def test_split_and_office(spark):
    docs = spark.createDataFrame([("d", 1, "# Section A\nalpha evidence\n# Section B\nbeta evidence"), ("e", 1, ""), ("f", 1, "x" * 7000), ("g", 1, None)], "item_id string, page long, text string")
    got = files.split_documents(docs).orderBy("item_id", "ord").collect()
    assert [(r.text, r.section) for r in got if r.item_id == "d"] == [("# Section A\nalpha evidence", "Section A"), ("# Section B\nbeta evidence", "Section B")]
    assert [len(r.text) for r in got if r.item_id == "f"] == [3200, 3200, 600] and not [r for r in got if r.item_id in "eg"]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    rows = spark.createDataFrame([("/x/a.docx", bytearray(body.getvalue())), ("/x/b.pptx", bytearray(b"junk")), ("/x/c.txt", bytearray(b"t"))], "path string, content binary")
    good, bad = files.rejects(files.extract_office_text(rows))
    assert [(r.path, r.text) for r in good.collect()] == [("/x/a.docx", "One two\n\nThree")] and [r.path for r in bad.collect()] == ["/x/b.pptx"]


def test_scan_and_watch(spark, tmp_path):
    root = tmp_path / "library"
    for name in ("a.md", "sub/b.TXT", "node_modules/c.md", "d.mp4"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    got = files.scan_files(spark, [str(root)], "document").collect()
    assert [r.title for r in got] == ["a", "b"] and all(len(r.external_id) == 16 for r in got)
    seen = []
    stream = streams.discover_stream(files.watch_files(spark, str(root), "document"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    stream.awaitTermination(60)
    assert {r.title for r in seen} == {"a", "b"}


RSS = '<rss version="2.0" xmlns:itunes="i"><channel><title>Show</title><itunes:image href="http://x/i.png"/><item><guid>1</guid><title> One  two </title><enclosure url="http://x/1.mp3"/><pubDate>d</pubDate></item><item><title>No id</title><enclosure url="http://x/2.mp3"/></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Blog</title><entry><id>e1</id><title>E</title><link href="http://x/p"/><link rel="enclosure" href="http://x/e.mp3"/><updated>u</updated></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/"><channel><title>Old</title></channel><item><title>O</title><link>http://x/o</link></item></rdf:RDF>'


def test_feeds(spark):
    bodies = [("rss", RSS.encode()), ("atom", ATOM.encode()), ("rdf", RDF.encode()), ("latin", '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><title>Café</title></channel></rss>'.encode("latin-1")), ("html", b"<html/>"), ("bad", b"<"), ("none", None)]
    parsed = feeds.parse_feeds(spark.createDataFrame([(u, bytearray(b) if b is not None else None) for u, b in bodies], "feed_url string, body binary"))
    got = {(r.feed_url, r.ord): r for r in parsed.collect()}
    assert (got["rss", 0].external_id, got["rss", 0].title, got["rss", 0].enclosure_url) == ("1", "One two", "http://x/1.mp3") and len(got["rss", 1].external_id) == 16
    assert got["atom", 0].enclosure_url == "http://x/e.mp3" and got["rdf", 0].enclosure_url == "http://x/o"
    assert {u for (u, _), r in got.items() if r.error} == {"html", "bad", "none"}
    summary = {r.feed_url: (r.title, r.episode_count) for r in feeds.feed_summary(parsed).collect()}
    assert summary == {"rss": ("Show", 2), "atom": ("Blog", 1), "rdf": ("Old", 1), "latin": ("Café", 0)}


def test_urls(spark):
    cases = {
        "https://youtu.be/abc": ("youtube", "single"), "https://www.youtube.com/watch?v=abc": ("youtube", "single"), "https://www.youtube.com/@name": ("youtube", "author"), "https://www.youtube.com/playlist?list=x": None, "https://www.bilibili.com/video/BV1?p=2": ("bilibili", "single"),
        "https://space.bilibili.com/42": ("bilibili", "author"), "ftp://x/y": None, "http://user:pw@youtube.com/watch?v=a": None, "http://127.0.0.1/a": None, "http://10.1.2.3/a": None, "http://100.64.0.1/": None, "http://[::1]/": None, "http://box.local/": None, "not a url": None, "https://example.com/v": None,
    }
    got = {r.url: r for r in urls.classify_source_urls(spark.createDataFrame([(u,) for u in cases], "url string")).collect()}
    assert {u: (r.platform, r.kind) if r.platform else None for u, r in got.items()} == cases
    assert got["https://www.youtube.com/@name"].canonical_url == "https://www.youtube.com/@name/videos" and got["https://www.bilibili.com/video/BV1?p=2"].canonical_url == "https://www.bilibili.com/video/BV1?p=2"


def test_discovery(spark):
    items = spark.createDataFrame([("1", "s", "e1", "/a", "indexed"), ("2", "s", "old", "/b", "indexed"), ("3", "s", "gone", "/c", "discovered")], "id string, source_id string, external_id string, raw_path string, status string")
    for c, kind in (("title", "string"), ("content_type", "string"), ("discovered_at", "long")):
        items = items.withColumn(c, F.lit(None).cast(kind))
    found = spark.createDataFrame([("s", "e1", "/a", "A", "video", 0), ("s", "new", "/b", "B", "video", 1), ("s", "x", "/x", "X", "video", 2), ("s", "x", "/x2", "X2", "video", 3), ("s", "dead", "/d", "D", "video", 4)], "source_id string, external_id string, raw_path string, title string, content_type string, ord int")
    dead = spark.createDataFrame([("s", "dead", 1, "r", None)], S.IGNORED)
    out, changed = discovery.upsert_discovered(items, found, dead, 99)
    got = {r.external_id: r for r in out.collect()}
    assert set(got) == {"e1", "new", "gone", "x"} and got["e1"].status == "indexed" and (got["new"].id, got["new"].status) == ("2", "discovered") and got["x"].title == "X2"
    assert [r.item_id for r in changed.collect()] == ["2"]
    jobs = spark.createDataFrame([("2", "index_video", "running")], "item_id string, job_type string, status string")
    assert {r.item_id for r in discovery.plan_index_jobs(out.where("content_type is not null"), jobs).collect()} == {got["x"].id}


def test_vectors_and_generations(spark, tmp_path):
    vectors, queries = V.make_vector_workload(spark, 300, 16, 20, noise=0.01)
    exact = V.vector_topk(queries, vectors, 5)
    assert J.recall_at_k(exact, exact, 5).first()[0] == 1.0
    near = A.ann_topk(queries, vectors, 5, lists=10, probes=10)
    assert J.recall_at_k(near, exact, 5).first()[0] >= 0.9
    units = spark.createDataFrame([("u1", "i", "moment", "hello world", "f.jpg"), ("u2", "i", "image", None, "g.jpg")], "id string, item_id string, unit_kind string, content_text string, representative_frame_path string")
    assert {(r.point_key, r.input_kind) for r in V.plan_embeddings(units).collect()} == {("u1", "text"), ("u1:image", "image"), ("u2", "image")}
    base = str(tmp_path / "index")
    assert V.embed_and_commit_generation(units, lambda: V.hashing_embedder(8), base, 1, 8)
    assert not V.embed_and_commit_generation(units, lambda: V.hashing_embedder(9), base, 2, 8)
    assert V.current_generation(spark, base).first().generation == 1
    assert not V.embed_and_commit_generation(units, lambda: V.hashing_embedder(8), base, 1, 8)  # a second writer of it
    assert len(list((tmp_path / "index").glob("generation=*"))) == 1
    stored = spark.read.parquet(f"{V.current_generation(spark, base).first().path}/vectors")
    kept = spark.createDataFrame([("i", "u1")], "item_id string, point_key string")
    assert [r.point_key for r in V.drop_stale_vectors(stored, kept).collect()] == ["u1"]


def test_entities(spark):
    said = spark.createDataFrame([("We met Ada Lovelace and The Analytical Engine Works Group Today. An agent and ADA LOVELACE",), (None,), ("",)], "text string")
    every = ["agent", "Ada Lovelace", "Analytical Engine Works Group", "Today An", "ADA LOVELACE"]
    assert [r.c for r in said.select(G.candidate_labels().alias("c")).collect()] == [every, [], []]
    assert [r.c for r in said.select(G.candidate_labels(most=12).alias("c")).collect()] == [every[:4], [], []] and said.select(G.candidate_labels(most=2).alias("c")).first().c == every[:2]
    items = spark.createDataFrame([("i", 5, 100.0)], "id string, indexed_at long, duration_sec double")
    told = spark.createDataFrame([("i", json.dumps({"topics": ["Graph search", "ab"], "events": [{"entities": ["Ada Lovelace"]}]}))], "item_id string, result string")
    rows = spark.createDataFrame([chunk("i", "c", "transcript", 0.0, 1.0, "Then Ada Lovelace spoke")], S.CHUNKS)
    mentions = G.dedupe_mentions(G.entity_mentions(items, told, rows))
    got = {r.entity: (r.label, r.mentions, r["items"], r.kind) for r in G.entity_summary(mentions).collect()}
    assert got["ada-lovelace"] == ("Ada Lovelace", 1, 1, "person_or_entity") and "graph-search" in got and "ab" not in got and "then-ada-lovelace" in got
    week = G.weekly_review(items, spark.createDataFrame([("i", 250.0)], "item_id string, position_sec double"), mentions, 6).first()
    assert (week.n_items, week.watched_percent) == (1, 100) and len(week.topics) == 3


def test_retention_equals_stepwise_rule(spark):
    rng = random.Random(4)
    rows = [(f"/f{k:03}", rng.randint(1, 50), rng.randint(0, 10 * 86_400)) for k in range(200)]
    got = {r.path for r in I.retention_plan(spark.createDataFrame(rows, "path string, length long, modified long"), 2000).collect()}
    total, want = sum(r[1] for r in rows), set()
    for path, size, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if total <= 2000:
            break
        want.add(path)
        total -= size
    assert got == want


def test_usage_and_cost(spark):
    rows = [("asr", "whisper-1", "openai", "https://x", 120.0, 0, 0), ("asr", "whisper-large-v3-turbo", "c", "https://api.groq.com/v1", 3600.0, 0, 0), ("embedding_text", "gemini-embedding-2", None, None, 0.0, 2_000_000, 0), ("embedding_image", "gemini-embedding-2", None, None, 0.0, 0, 10), ("asr", "other", None, None, 9.0, 0, 0)]
    frame = spark.createDataFrame(rows, "capability string, model_id string, provider_type string, base_url string, audio_seconds double, input_tokens long, image_count long")
    got = [None if r.estimated_usd is None else round(r.estimated_usd, 6) for r in H.estimate_cost(frame).collect()]
    assert got == [0.012, 0.04, 0.4, 0.0012, None]
    empty = H.usage_totals(spark.createDataFrame([], S.USAGE)).first()
    assert empty.events == 0 and empty.estimated_usd == 0


def test_streams_equal_batch(spark, tmp_path):
    rows = [(1_704_067_200 + 3600 * k, f"i{k % 3}", 1, k, 0, 0.0, 0, 0.0, float(k), 0.0) for k in range(60)]
    frame = spark.createDataFrame(rows, "created_at long, item_id string, request_count long, input_tokens long, output_tokens long, audio_seconds double, image_count long, video_seconds double, estimated_usd double, billed_credits double").withColumn("ts", F.timestamp_seconds("created_at"))
    frame.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = streams.to_memory(streams.usage_stream(source), "usage_days", "complete", str(tmp_path / "cp1"))
    q.awaitTermination(120)
    got = {(r.day, r.events, r.estimated_usd) for r in spark.table("usage_days").collect()}
    assert got == {(r.day, r.events, r.estimated_usd) for r in H.daily_usage(frame).collect()}
    updates = source.select("item_id", F.col("created_at").alias("updated_at"), F.col("estimated_usd").alias("position_sec"))
    q = streams.to_memory(streams.playback_stream(updates), "positions", "complete", str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert {(r.item_id, r.position_sec) for r in spark.table("positions").collect()} == {("i0", 57.0), ("i1", 58.0), ("i2", 59.0)}


def test_jobs_and_state(spark):
    items = spark.createDataFrame([("i", "failed", None, '{"artifacts":{"status":"indexed"}}'), ("k", "processing", 5, None)], "id string, status string, indexed_at long, metadata string")
    jobs = spark.createDataFrame([("1", "i", "index_video", "completed", 1, 9, None), ("2", "k", "index_video", "running", 3, None, None), ("3", "i", "index_video", "failed", 4, 5, "Missing API key"), ("4", None, "index_audio", "queued", None, None, " ")], "id string, item_id string, job_type string, status string, started_at long, finished_at long, error string").withColumn("progress", F.lit(0.5)).withColumn("stage", F.lit(None).cast("string"))
    assert {r.id for r in I.latest_logical_jobs(jobs, items).collect()} == {"1", "2", "4"}
    codes = {r.id: r.error_code for r in I.classify_job_errors(jobs).collect()}
    assert codes == {"1": None, "2": None, "3": "missing_api_key", "4": None}
    fixed = {r.id: (r.status, r.indexed_at) for r in I.repair_item_status(items, jobs, 99).collect()}
    assert fixed["i"] == ("indexed", 9)
    queued, back = I.requeue_interrupted(jobs, items)
    assert {r.id for r in queued.where("status = 'queued'").collect()} == {"2", "4"} and {r.id: r.status for r in back.collect()}["k"] == "indexed"
    assert {r.id for r in I.orphan_jobs(jobs, items).collect()} == {"4"}
    out, _ = I.cancel_queued(jobs, items, spark.createDataFrame([("4",)], "id string"), 50)
    assert {r.id: r.status for r in out.collect()}["4"] == "cancelled"


def test_evidence_products(spark):
    rows = [(1, "u1", 1, "video", 0.0, 10.0, "/a.mp4", "Clip", None, "p.jpg"), (1, "u2", 2, "audio", 5.0, 9.0, "/b.mp3", "Talk", None, None), (1, "u3", 3, "image", None, None, "/c.png", "Pic", None, "q.jpg"), (1, "u4", 4, "video", 3.0, 3.1, "/d.mp4", "Short", None, "r.jpg")]
    hits = spark.createDataFrame(rows, "query_id int, unit_id string, rank int, modality string, start_sec double, end_sec double, raw_path string, item_title string, clip_path string, preview_path string").withColumn("item_id", F.col("unit_id"))
    shots = E.shot_list(hits)
    assert [r.shot_id for r in shots.orderBy("place").collect()] == ["shot-01", "shot-02", "shot-03"]
    gaps = E.broll_gaps(shots).collect()
    assert [(r.shot_id, r.candidates) for r in gaps] == [("shot-02", ["shot-01", "shot-03"])]
    clips = {r["name"]: (r.track, r.offset_ms, r.duration_ms) for r in E.timeline_clips(shots).collect()}
    assert clips == {"Clip": ("Video", 0, 10_000), "Pic": ("Video", 10_000, 4000), "Talk": ("Audio", 0, 4000)}
    timeline = json.loads(E.timeline_export(shots).first().timeline)
    assert [t["name"] for t in timeline["tracks"]] == ["Video", "Audio"]
    summary = E.material_summary(hits).first()
    assert (summary.n_results, summary.modalities) == (4, ["video", "audio", "image"])


def test_library_columns(spark):
    moments = spark.createDataFrame([("m1", "i", "c", 65.0, None, None, "quote", None, 1), ("m2", "i", "zz", 1.0, None, "T", "q", None, 2), ("m3", "no", None, 1.0, None, "T", "q", None, 3)], S.MOMENTS)
    items = spark.createDataFrame([("i", "Item")], "id string, title string")
    rows = spark.createDataFrame([chunk("i", "c", "transcript", 60.0, 70.0, "x")], S.CHUNKS)
    good, bad = LIB.validate_moments(moments, items, rows)
    assert {r.id for r in good.collect()} == {"m1"} and {r.id for r in bad.collect()} == {"m2", "m3"}
    text = LIB.export_moments(LIB.list_moments(good, items)).first().text
    assert text == "## Item (1:05)\n\n> quote"
    gate = J.quality_gate(spark.createDataFrame([("a", 0.5)], "query_type string, ndcg double"), spark.createDataFrame([("a", 0.6)], "query_type string, ndcg double"))
    assert gate.first().passed is False
