"""Registered queries of the ingest, evidence, unit and search operators (A-E), with the SQL that says the same."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import portions, shared_path, stored, stored_as, text_batches
from ..operators import chunks as B
from ..operators import evidence as E
from ..operators import lexical as L
from ..operators import quality as J
from ..operators import ranking as R
from ..operators import units as C
from ..operators import vectors as V
from ..sources import discovery as D
from ..sources.feeds import feed_summary, parse_feeds
from ..sources.files import BUDGET, extract_office_text, scan_files, split_documents
from ..sources.urls import classify_source_urls, select_source_url
from . import adapters as A
from .queries import FRAMES_SQL, NOW, TOKENS_SQL, _index, _units, query
from .search import hybrid_search, legacy_chunk_search
from .state_queries import _number, _pick, _sql_pick


def _conv():
    return F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))


def _turns(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "conversations").withColumn("item_id", _conv())


# A

def _feeds(spark, sf_dir):
    """A feed for each conversation with an entry for each turn; every fifth body is no feed, every third has no title."""
    entry = F.format_string('<item><guid>g%d</guid><title>Turn &amp; %d</title><enclosure url="https://a.b/%d.mp3"/></item>', "turn", "turn", "turn")
    bodies = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda s: s["e"]), "").alias("items"))
    title = F.when(F.col("conv_id") % 3 != 0, F.format_string("<title>Feed %d</title>", "conv_id")).otherwise("")
    body = F.when(F.col("conv_id") % 5 == 0, "<html><body/></html>").otherwise(F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), title, "items", F.lit("</channel></rss>")))
    return bodies.select(F.format_string("https://feeds/%d", "conv_id").alias("feed_url"), body.alias("body"))


@query("""
SELECT 'https://feeds/' || conv_id AS feed_url, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord, 'g' || turn AS external_id, 'Turn & ' || turn AS title, 'https://a.b/' || turn || '.mp3' AS enclosure_url
FROM conversations WHERE conv_id % 5 <> 0 QUALIFY ord < 3""")
def feed_entries(spark, sf_dir):
    """The first three entries of every feed."""
    found = parse_feeds(_feeds(spark, sf_dir), 3).where("ord is not null")
    return found.select("feed_url", "ord", "external_id", "title", "enclosure_url")


@query("SELECT 'https://feeds/' || conv_id AS feed_url, CASE WHEN conv_id % 3 <> 0 THEN 'Feed ' || conv_id ELSE 'Podcast feed' END AS title, count(*) AS episode_count FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id")
def feed_summaries(spark, sf_dir):
    return feed_summary(parse_feeds(_feeds(spark, sf_dir), None)).select("feed_url", "title", "episode_count")


ADDRESSES = (
    ("https://www.youtube.com/watch?v=a1", "youtube", "single"), ("http://youtu.be/a1", "youtube", "single"), ("https://youtu.be/", None, "missing video id"), ("https://youtube.com/playlist?list=x", None, "playlists are not supported"),
    ("https://m.youtube.com/shorts/q", "youtube", "single"), ("https://www.youtube.com/@name", "youtube", "author"), ("https://youtube.com/feed", None, "unsupported YouTube URL"), ("https://www.bilibili.com/video/BV1?p=3", "bilibili", "single"),
    ("https://space.bilibili.com/12", "bilibili", "author"), ("https://b23.tv/x", "bilibili", "single"), ("https://bilibili.com/", None, "unsupported Bilibili URL"), ("ftp://youtu.be/a", None, "must be http or https"),
    ("https://u:p@youtu.be/a", None, "must not include credentials"), ("http://127.0.0.1/a", None, "must not target local or private network hosts"), ("http://192.168.1.9/a", None, "must not target local or private network hosts"), ("https://example.com/v", None, "unsupported video host"),
)


@query("SELECT event_id, platform, kind, reject_reason FROM events JOIN (VALUES " + ", ".join("({}, {}, {}, {})".format(k, f"'{p}'" if p else "NULL", f"'{w}'" if p else "NULL", "NULL" if p else f"'{w}'") for k, (_, p, w) in enumerate(ADDRESSES)) + f") AS a(k, platform, kind, reject_reason) ON event_id % {len(ADDRESSES)} = k")
def source_url_kinds(spark, sf_dir):
    """Every event with one of the addresses that the rules tell apart."""
    urls = A.table(spark, sf_dir, "events").select("event_id", _pick(F.col("event_id"), *(u for u, _, _ in ADDRESSES)).alias("url"))
    return classify_source_urls(urls).select("event_id", "platform", "kind", "reject_reason")


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'https://w/' || event_id WHEN 1 THEN 'http://s/' || event_id WHEN 2 THEN 'https://www.youtube.com/watch?v=y' || event_id WHEN 3 THEN 'https://www.bilibili.com/video/y' || event_id WHEN 4 THEN 'https://feed/' || event_id END AS url FROM events""")
def item_source_urls(spark, sf_dir):
    n = F.col("event_id")
    metadata = (
        F.when(n % 6 == 0, F.format_string('{"webpage_url":"https://w/%d","url":"https://u"}', n)).when(n % 6 == 1, F.format_string('{"webpage_url":"file:///x","source_url":"http://s/%d"}', n))
        .when(n % 6 == 2, F.format_string('{"platform":"youtube","platform_id":"y%d"}', n)).when(n % 6 == 3, F.format_string('{"platform":"bilibili","platform_id":"y%d"}', n)).otherwise("{}")
    )
    config = F.when(n % 6 == 4, F.format_string('{"path":"/x","feed_url":"https://feed/%d"}', n)).otherwise("not json")
    return A.table(spark, sf_dir, "events").withColumns({"metadata": metadata, "config": config}).select("event_id", select_source_url().alias("url"))


@query("""
SELECT CASE WHEN turn % 4 = 1 THEN 'd' ELSE 'i' END || conv_id || '-' || turn AS external_id, 'Video ' || turn AS title, 60.5 * turn AS duration, CASE WHEN turn % 2 = 0 THEN 'own' ELSE 'youtube' END AS platform
FROM conversations WHERE turn % 4 <> 3""")
def listed_videos(spark, sf_dir):
    """Listing lines of every turn; those without an id are left out."""
    n = F.col("turn")
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("-"), n.cast("string"))
    line = F.to_json(F.struct(
        F.when(n % 4 == 1, None).when(n % 4 == 3, None).otherwise(F.concat(F.lit("i"), ident)).alias("id"), F.when(n % 4 == 1, F.concat(F.lit("d"), ident)).alias("display_id"),
        F.concat(F.lit("Video "), n.cast("string")).alias("title"), (60.5 * n).alias("duration"), F.when(n % 2 == 0, "own").alias("platform"),
    ))
    lines = _turns(spark, sf_dir).select(line.alias("value"), "item_id", F.col("turn").alias("pos")).withColumnRenamed("item_id", "file")
    return D.video_listings(lines, {"platform": "youtube"}).select("external_id", "title", "duration", "platform")


@query(f"SELECT event_type AS stage, count(*) AS n, min(CASE WHEN event_id % 4 = 0 THEN {NOW} ELSE floor(epoch(ts))::BIGINT END) AS first FROM events GROUP BY event_type")
def event_log(spark, sf_dir):
    """Events as a log of JSON lines, some without a time, written and read back."""
    e = A.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.when(F.col("event_id") % 4 != 0, F.unix_timestamp("ts")).alias("ts"), F.lit("info").alias("level"), F.col("event_type").alias("stage")))
    path = stored_as(e.select(line.alias("value")), "text")
    return D.read_event_log(spark, path, NOW).groupBy("stage").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("SELECT 2 AS index_version, (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM documents WHERE regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') <> '') AS units")
def published_tables(spark, sf_dir):
    """Items and units written as one snapshot, found again by its pointer."""
    base = stored_as(spark.range(1), "parquet")
    D.publish_snapshot(spark, base, 1, {"items": (A.document_items(spark, sf_dir).limit(0), ()), "units": (_units(spark, sf_dir).limit(0), ("index_version",))})
    D.publish_snapshot(spark, base, 2, {"items": (A.document_items(spark, sf_dir), ()), "units": (_units(spark, sf_dir), ("index_version",))})
    items, units = (D.current_table(spark, base, name) for name in ("items", "units"))
    return units.groupBy(F.col("index_version").cast("int").alias("index_version")).agg(F.count("*").alias("units")).join(items.agg(F.count("*").alias("items")))  # one row each


def _office(batches):
    """Office files of documents: a docx of one paragraph a line, a pptx of one slide a line; every tenth file is cut off."""
    for batch in portions(batches, "text"):
        files = []
        for n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held, made = io.BytesIO(), [f"<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>" for line in (text or "").split("\n")]
            pages = {"word/document.xml": "".join(made)} if n % 2 == 0 else {f"ppt/slides/slide{k + 1}.xml": x for k, x in enumerate(made)}
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for name, body in reversed(pages.items()):
                    z.writestr(name, f'<a:x xmlns:a="urn:a">{body}</a:x>')
            files.append((f"/{n}.{'docx' if n % 2 == 0 else 'pptx'}", held.getvalue()[: 20 if n % 10 == 7 else None]))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.binary())], names=["path", "content"])


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 7)
SELECT '/' || doc_id || '.docx' AS path, 1::BIGINT AS page, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10))) AS digest, false AS bad FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT '/' || doc_id || '.pptx', page, md5(trim(line)), false FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM d WHERE doc_id % 2 = 1)
UNION ALL SELECT '/' || doc_id || '.pptx', NULL, NULL, true FROM documents WHERE doc_id % 10 = 7""")
def office_text(spark, sf_dir):
    """Every document as an office file and its text found again, by page; files that are cut off are named."""
    files = text_batches(A.table(spark, sf_dir, "documents")).select("doc_id", "text").mapInArrow(_office, "path string, content binary")
    return extract_office_text(files).select("path", "page", F.md5("text").alias("digest"), F.col("error").isNotNull().alias("bad"))


@query(r"""
SELECT 'doc-' || doc_id AS item_id, md5(regexp_replace(text, '\s+', '', 'g')) AS digest, true AS within, 1::BIGINT AS first_page FROM documents WHERE regexp_replace(text, '\s+', '', 'g') <> ''""")
def split_documents_whole(spark, sf_dir):
    """The pieces of every document, put together again: nothing but white space is lost, and no piece is longer than a chunk may be."""
    docs = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.lit(1).alias("page"), "text")
    pieces = split_documents(docs).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), "").alias("whole"), F.max(F.length("text")).alias("longest"), F.min("page").alias("first_page"))
    return pieces.select("item_id", F.md5(F.regexp_replace("whole", r"[ \t\n\f\r]+", "")).alias("digest"), (F.col("longest") <= BUDGET).alias("within"), "first_page")


# B

@query("SELECT item_id, turn FROM (SELECT 'conv-' || conv_id AS item_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role")
def changed_frames(spark, sf_dir):
    """Frames whose bytes (here: the role) differ from the frame before."""
    frames = _turns(spark, sf_dir).select("item_id", F.col("turn").alias("frame_no"), F.col("role").cast("binary").alias("content"))
    return B.drop_adjacent_duplicate_frames(frames).select("item_id", F.col("frame_no").alias("turn"))


def _ocr(spark, sf_dir):
    """On-screen text for the frames of even turns, with the text of the turn."""
    rows = _turns(spark, sf_dir).where("turn % 2 = 0")
    rows = B.ocr_rows(rows.select("item_id", "text", F.format_string("f-%d-%d.jpg", "conv_id", "turn").alias("frame_path")))
    return rows.withColumn("id", F.concat("item_id", F.lit(":ocr:"), F.regexp_extract("frame_path", r"(\d+)\.jpg", 1))).withColumn("metadata", F.lit(None).cast("string"))


@query(r"SELECT 'conv-' || conv_id AS item_id, 'f-' || conv_id || '-' || turn || '.jpg' AS frame_path, 12.0::DOUBLE * turn + 5 AS eff_start, 12.0::DOUBLE * turn + 5 AS eff_end FROM conversations WHERE turn % 2 = 0 AND regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''")
def timed_ocr_rows(spark, sf_dir):
    """On-screen rows with the time of their frame."""
    rows = _ocr(spark, sf_dir).unionByName(A.frames(spark, sf_dir), allowMissingColumns=True)
    return C.effective_times(rows).where("chunk_type = 'ocr'").select("item_id", "frame_path", "eff_start", "eff_end")


def _understandings(spark, sf_dir):
    """A result for each conversation: chapters and events of its turns, some without a title."""
    n = F.col("turn")
    chapter = F.when(n % 3 == 0, F.struct("turn", F.struct(F.when(n % 6 != 0, F.format_string("Chapter %d", n)).alias("title"), (12.0 * n).alias("start_sec"), F.when(n % 2 == 0, "more").alias("summary")).alias("c")))
    event = F.when(n % 3 == 1, F.struct("turn", F.struct(F.format_string("Event %d", n).alias("caption"), (12.0 * n).alias("start"), (12.0 * n + 6).alias("end")).alias("c")))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["c"])
    told = _turns(spark, sf_dir).groupBy("conv_id", "item_id").agg(listed(chapter).alias("chapters"), listed(event).alias("events"))
    k = F.col("conv_id")
    result = F.struct(
        F.when(k % 3 == 0, F.format_string("Shown %d", k)).alias("display_title"), F.when(k % 4 != 0, F.format_string("Summary %d", k)).alias("summary"), F.when(k % 2 == 0, F.format_string("Explicit %d, Shown 6", k)).alias("searchable_text"), F.array(F.lit("t1"), F.lit("t2")).alias("topics"), "chapters", "events",
    )
    return told.select("conv_id", "item_id", F.to_json(result).alias("result"), F.when(k % 8 == 0, "kept summary").alias("summary"))


@query("""
SELECT 'conv-' || conv_id AS item_id, 'summary' AS kind, 0 AS ord, NULL::DOUBLE AS start_sec, NULL::DOUBLE AS end_sec, CASE WHEN conv_id % 4 <> 0 THEN 'Summary ' || conv_id ELSE 'kept summary' END AS text FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 <> 0 OR conv_id % 8 = 0
UNION ALL SELECT 'conv-' || conv_id, 'chapter', ord, 12.0 * turn, NULL, 'Chapter ' || turn || CASE WHEN turn % 2 = 0 THEN ': more' ELSE '' END FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord FROM conversations WHERE turn % 3 = 0) WHERE turn % 6 <> 0
UNION ALL SELECT 'conv-' || conv_id, 'event', (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT, 12.0 * turn, 12.0 * turn + 6, 'Event ' || turn FROM conversations WHERE turn % 3 = 1""")
def understanding_rows(spark, sf_dir):
    return B.explode_understanding(_understandings(spark, sf_dir))


@query("""
WITH c AS (SELECT conv_id, string_agg('Chapter ' || turn, E'\\n' ORDER BY turn) FILTER (turn % 3 = 0 AND turn % 6 <> 0) AS chapters, string_agg('Event ' || turn, E'\\n' ORDER BY turn) FILTER (turn % 3 = 1) AS events FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Shown ' || conv_id END AS shown, CASE WHEN conv_id % 2 = 0 THEN 'Explicit ' || conv_id || ', Shown 6' ELSE concat_ws(E'\\n', CASE WHEN conv_id % 4 <> 0 THEN 'Summary ' || conv_id END, chapters, events, E't1\\nt2') END AS body FROM c)
SELECT 'conv-' || conv_id AS item_id, concat_ws(E'\\n', shown, body) AS text FROM b""")
def understanding_texts(spark, sf_dir):
    return _understandings(spark, sf_dir).select("item_id", B.understanding_search_text("result").alias("text"))


@query("""
SELECT 'conv-' || conv_id AS item_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE count(*) + count(*) FILTER (turn % 2 = 0) END AS rows FROM conversations GROUP BY conv_id""")
def replaced_chunks(spark, sf_dir):
    """Every second conversation gets two new rows instead of its own."""
    rows = A.media_chunks(spark, sf_dir)
    fresh = _turns(spark, sf_dir).where("conv_id % 2 = 0").select("item_id").distinct().withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    fresh = fresh.select(F.format_string("%s:transcript:new%d", "item_id", "n").alias("id"), "item_id", F.lit("transcript").alias("chunk_type"))
    return B.replace_item_chunks(rows, fresh).groupBy("item_id").agg(F.count("*").alias("rows"))


@query("SELECT 'conv-' || conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'Shown ' || conv_id WHEN 1 THEN 'Conversation ' || conv_id END AS title FROM (SELECT DISTINCT conv_id FROM conversations)")
def display_titles(spark, sf_dir):
    n = _number()
    items = A.media_items(spark, sf_dir).withColumns({"metadata": F.when(n % 3 == 0, F.format_string('{"display_title":"  Shown %d "}', n)).otherwise('{"display_title":" "}'), "title": F.when(n % 3 != 2, F.col("title")).otherwise("  ")})
    return items.select("id", B.display_title().alias("title"))


@query("""
SELECT 'conv-' || conv_id AS item_id, string_agg(kind || ':' || turn, ' ' ORDER BY turn) AS rows FROM (
  SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'transcript_line' WHEN 1 THEN 'transcript' ELSE 'document' END AS kind FROM conversations) GROUP BY conv_id""")
def shown_transcripts(spark, sf_dir):
    """Which rows a transcript shows: lines before windows, windows before pages."""
    t = _turns(spark, sf_dir)
    kinds = {"transcript_line": "conv_id % 3 = 0", "transcript": "conv_id % 3 <> 2", "document": "true", "ocr": "true"}
    rows = None
    for kind, where in kinds.items():
        one = t.where(where).select("item_id", F.lit(kind).alias("chunk_type"), "turn")
        rows = one if rows is None else rows.unionByName(one)
    shown = B.display_transcript(rows).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("turn", "chunk_type"))).alias("rows"))
    return shown.select("item_id", F.array_join(F.transform("rows", lambda s: F.concat_ws(":", s["chunk_type"], s["turn"].cast("string"))), " ").alias("rows"))


# C

NOTES_SQL = """
WITH n AS (SELECT 'conv-' || conv_id AS item_id, turn, turn // 3 AS range, turn % 3 AS k, 'note ' || turn // 2 AS text FROM conversations),
e AS (SELECT item_id, range, max(CASE WHEN k > 0 THEN 2 ELSE 1 END) AS best FROM n GROUP BY ALL),
w AS (SELECT n.item_id, n.range, string_agg(DISTINCT text, E'\\n' ORDER BY text) AS visual_text FROM n JOIN e ON n.item_id = e.item_id AND n.range = e.range AND CASE WHEN k > 0 THEN 2 ELSE 1 END = best GROUP BY ALL)
"""


@query(NOTES_SQL + """
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY range) - 1)::INT AS ord, 36.0::DOUBLE * range AS window_start, 36.0::DOUBLE * range + 36 AS window_end, visual_text, NULL::VARCHAR AS summary_text FROM w
UNION ALL SELECT DISTINCT 'conv-' || conv_id, 1 << 30, NULL::DOUBLE, NULL::DOUBLE, NULL, 'all of it' FROM conversations""")
def understanding_ranges(spark, sf_dir):
    """Notes of equal ranges become one window, events before chapters; equal texts stand once; the summary is last."""
    t, n = _turns(spark, sf_dir), F.col("turn")
    begin = 36.0 * F.floor(n / 3)
    notes = t.select("item_id", F.format_string("%s:understanding:%06d", "item_id", "turn").alias("id"), begin.alias("start_sec"), (begin + 36).alias("end_sec"), F.format_string("note %d", F.floor(n / 2)).alias("text"), F.when(n % 3 > 0, '{"kind":"event"}').otherwise('{"kind":"chapter"}').alias("metadata"))
    none = F.lit(None).cast("double")
    whole = t.select("item_id").distinct().select("item_id", F.concat("item_id", F.lit(":understanding:summary")).alias("id"), none.alias("start_sec"), none.alias("end_sec"), F.lit("all of it").alias("text"), F.lit('{"kind":"summary"}').alias("metadata"))
    found = C.understanding_windows(notes.unionByName(whole).withColumn("chunk_type", F.lit("understanding")))
    return found.withColumn("ord", F.col("ord").cast("int"))


@query("""
SELECT 'conv-' || conv_id AS item_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord, 12.0::DOUBLE * turn + 5 AS window_start, 12.0::DOUBLE * turn + 15 AS window_end FROM conversations WHERE turn % 2 = 0""")
def frame_windows(spark, sf_dir):
    """One window a frame, as for items whose evidence has no time of its own."""
    return C.visual_only_windows(C.effective_times(A.frames(spark, sf_dir))).select("item_id", "ord", "window_start", "window_end")


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM conversations),
a AS (SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 400) AS text FROM t WHERE text <> '' GROUP BY conv_id)
SELECT 'conv-' || conv_id AS item_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS text FROM a""")
def budgeted_texts(spark, sf_dir):
    """The first 400 characters of every conversation's turns."""
    return C.budgeted_text(_turns(spark, sf_dir), ["item_id"], F.col("turn"), 400, "body").select("item_id", F.col("body").alias("text"))


UNITS_SQL = FRAMES_SQL + r""",
t AS (SELECT 'conv-' || conv_id AS item_id, conv_id, turn, 12.0::DOUBLE * turn AS s, 12.0::DOUBLE * turn + 12 AS e, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM conversations),
x AS (SELECT w.item_id, any_value(conv_id) AS conv_id, w.k, ws, we, min(turn) AS first_turn,
             trim(regexp_replace(left(string_agg(text, ' ' ORDER BY s, turn) FILTER (text <> ''), 3200), '[\s\p{Z}]+', ' ', 'g')) AS text FROM w JOIN t ON t.item_id = w.item_id AND t.s < w.we AND t.e > w.ws GROUP BY w.item_id, w.k, ws, we),
f AS (SELECT x.item_id, x.k, c.turn FROM x JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 2 = 0) c ON c.conv_id = x.conv_id QUALIFY row_number() OVER (PARTITION BY x.item_id, x.k ORDER BY abs(12.0 * c.turn + 5 - ws), c.turn) = 1),
u AS (SELECT x.*, x.item_id || ':unit:' || lpad(x.k::VARCHAR, 6, '0') AS id, f.turn AS frame FROM x LEFT JOIN f ON f.item_id = x.item_id AND f.k = x.k WHERE text <> '')
"""


@query(UNITS_SQL + """
SELECT id, item_id, k AS unit_index, 'moment' AS unit_kind, ws AS start_sec, we AS end_sec, md5(text) AS transcript, item_id || ':transcript:' || lpad(first_turn::VARCHAR, 6, '0') AS representative_chunk_id, 'f-' || conv_id || '-' || frame || '.jpg' AS representative_frame_path,
       md5('Title: Conversation ' || conv_id || E'\\nSource: talks\\nTime: ' || printf('%.1fs-%.1fs', ws, we) || E'\\nTranscript: ' || text) AS content, 2 AS index_version, '{"window":"timed"}' AS metadata FROM u""")
def timed_unit_rows(spark, sf_dir):
    """Every moment of every conversation, with its text, frame and content."""
    items = A.media_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.lit("talks").alias("source_label"))
    units = C.build_timed_units(items, A.media_chunks(spark, sf_dir)).where("unit_kind = 'moment'")
    return units.select("id", "item_id", "unit_index", "unit_kind", "start_sec", "end_sec", F.md5("transcript_text").alias("transcript"), "representative_chunk_id", "representative_frame_path", F.md5("content_text").alias("content"), F.col("index_version").cast("int").alias("index_version"), "metadata")


@query("""
SELECT 'conv-' || conv_id || ':unit:' || lpad(n::VARCHAR, 6, '0') AS id, 'conv-' || conv_id || ':keyframe:' || lpad(turn::VARCHAR, 6, '0') AS representative_chunk_id, CASE WHEN turn % 4 = 0 THEN 'Image Make: M' || turn || '; GPS GPSLatitude: 1' END AS summary_text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE turn % 2 = 0)""")
def image_units(spark, sf_dir):
    """Every frame as an image, with what its camera says."""
    turn = _number()
    frames = A.frames(spark, sf_dir).withColumn("metadata", F.when(turn % 4 == 0, F.format_string('{"exif":{"Image Make":"M%d","Image Model":" ","GPS GPSLatitude":"1"}}', turn)))
    items = A.media_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.lit("talks").alias("source_label"))
    return C.build_image_units(items, frames).select("id", "representative_chunk_id", "summary_text")


@query(UNITS_SQL + r""",
i AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 = 0)
SELECT 'moment' AS unit_kind, count(*) AS n, count(DISTINCT item_id) AS items FROM u WHERE conv_id % 3 <> 0 UNION ALL SELECT 'image', count(*), count(DISTINCT conv_id) FROM i
UNION ALL SELECT 'document', count(*), count(*) FROM documents WHERE regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''""")
def units_by_kind(spark, sf_dir):
    """Units of a library of videos, images and documents."""
    media = A.media_items(spark, sf_dir).withColumn("content_type", F.when(_number() % 3 == 0, "image").otherwise("video"))
    columns = ["id", "source_id", "content_type", "title", "metadata"]
    items = media.select(columns).unionByName(A.document_items(spark, sf_dir).select(columns))
    chunks = A.media_chunks(spark, sf_dir).unionByName(A.document_chunks(spark, sf_dir))
    found = C.build_units(items, chunks, A.document_sources(spark, sf_dir))
    return found.groupBy("unit_kind").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))


@query(UNITS_SQL + "SELECT id AS unit_id, id || ':image' AS point_key, 'image' AS input_kind, 'f-' || conv_id || '-' || frame || '.jpg' AS input FROM u UNION ALL SELECT id, id, 'text', NULL FROM u")
def planned_embeddings(spark, sf_dir):
    """What is embedded for every moment: its text and its frame."""
    items = A.media_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.lit("talks").alias("source_label"))
    units = C.build_timed_units(items, A.media_chunks(spark, sf_dir)).where("unit_kind = 'moment'")
    return V.plan_embeddings(units).select("unit_id", "point_key", "input_kind", F.when(F.col("input_kind") == "image", F.col("input")).alias("input"))


@query("SELECT vec_id AS point_key, vec_id % 3 = 0 AS good FROM embeddings")
def validated_vectors(spark, sf_dir):
    """Vectors of the wrong length and with a missing number are told apart."""
    n = F.col("point_key")
    vectors = A.unit_vectors(spark, sf_dir).withColumn("vector", F.when(n % 3 == 0, F.col("vector")).when(n % 3 == 1, F.slice("vector", 1, 63)).otherwise(F.transform("vector", lambda x, i: F.when(i != 5, x))))
    good, bad = V.validate_vectors(vectors, 64)
    return good.select("point_key", F.lit(True).alias("good")).union(bad.select("point_key", F.lit(False)))


@query("SELECT vec_id AS point_key FROM embeddings WHERE label % 2 = 1 OR vec_id % 3 = 0 OR label NOT IN (SELECT label FROM embeddings WHERE vec_id % 3 = 0 AND label % 2 = 0)")
def current_vectors(spark, sf_dir):
    """Points of items that were built again and are not among what they kept are gone."""
    vectors = A.unit_vectors(spark, sf_dir)
    kept = vectors.where((F.col("point_key") % 3 == 0) & (F.substring("item_id", 7, 9).cast("int") % 2 == 0)).select("item_id", "point_key")
    return V.drop_stale_vectors(vectors, kept).select("point_key")


@query("""
WITH p AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'canonical' ELSE 'p' END || user_id AS id, CASE user_id % 4 WHEN 0 THEN 'retired' WHEN 1 THEN 'ready' WHEN 2 THEN 'building' ELSE 'other' END AS status, user_id FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT *, CASE status WHEN 'building' THEN 1 WHEN 'ready' THEN 2 ELSE 3 END AS status_rank FROM p)
SELECT user_id, id, status_rank, row_number() OVER (ORDER BY status_rank, id, user_id) = 1 AS active FROM r""")
def embedding_profiles(spark, sf_dir):
    """Profiles by status, under their canonical names; the first is active."""
    users = A.table(spark, sf_dir, "events").select("user_id").distinct()
    profiles = users.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("id"), _pick(F.col("user_id"), "retired", "ready", "building", "other").alias("status"), F.lit(64).alias("output_dimension"), "user_id")
    aliases = users.where("user_id % 10 = 0").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("alias"), F.concat(F.lit("canonical"), F.col("user_id").cast("string")).alias("canonical"))
    return V.embedding_profile_select(profiles, aliases).select("user_id", "id", "status_rank", "active")


# D

def _hits(spark, sf_dir):
    """Events as hits of their user's query, with evidence, times and kinds that vary."""
    n = F.col("event_id")
    text, vector = n % 3 != 0, (n % 2 == 0) | (n % 3 == 0)
    start = F.when(n % 11 != 0, (n % 200) * 3.0)
    name = lambda p, k: F.concat(F.lit(p), (n % k).cast("string"))
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("rank", F.row_number().over(by_user))  # before the rows get wide
    return e.select(
        F.col("user_id").alias("query_id"), "event_id", F.concat(F.lit("e-"), n.cast("string")).alias("unit_id"), name("i-", 50).alias("item_id"), F.concat(F.lit("Item "), (n % 50).cast("string")).alias("item_title"), name("s-", 7).alias("source_id"), name("p-", 97).alias("playback_chunk_id"),
        F.when(F.col("event_type") == "click", "transcript").when(F.col("event_type") == "view", "moment").when(F.col("event_type") == "purchase", "document").when(F.col("event_type") == "signup", "keyframe").otherwise("understanding").alias("chunk_type"),
        _pick(n % 50, "video", "audio", "image", "document").alias("item_content_type"), _pick(n % 50, "video", "audio", "image", "document").alias("modality"), start.alias("start_sec"), F.when(n % 5 != 0, start + n % 9).alias("end_sec"),
        ((n * 37 % 1000) / 1000).alias("score"), (text & (n % 17 == 0)).alias("exact_match"), text.alias("has_text"), vector.alias("has_vector"), F.when(vector, (n * 53 % 1000) / 1000).alias("similarity"),
        _pick(F.col("user_id"), "smart", "video", "audio", "image", "document").alias("preference"), F.when(n % 13 != 0, name("/m/", 50)).alias("raw_path"), F.when(n % 5 == 0, "c").alias("clip_path"), F.when(n % 4 == 0, "v").alias("preview_path"), (n % 50 + 1_000).alias("indexed_at"),
        "rank", F.repeat(F.concat(F.lit("lorem "), n.cast("string"), F.lit("  ")), (n % 70).cast("int")).alias("snippet"), F.when(n % 4 == 0, F.format_string('{"page":%d,"section":" S%d "}', n % 20, n % 3)).alias("unit_metadata"),
    )


HITS_SQL = f"""
WITH h AS (SELECT user_id AS query_id, event_id, 'e-' || event_id AS unit_id, 'i-' || event_id % 50 AS item_id, 'Item ' || event_id % 50 AS item_title, 's-' || event_id % 7 AS source_id, 'p-' || event_id % 97 AS playback_chunk_id,
                  CASE event_type WHEN 'click' THEN 'transcript' WHEN 'view' THEN 'moment' WHEN 'purchase' THEN 'document' WHEN 'signup' THEN 'keyframe' ELSE 'understanding' END AS chunk_type,
                  {_sql_pick("(event_id % 50)", "video", "audio", "image", "document")} AS item_type, CASE WHEN event_id % 11 <> 0 THEN (event_id % 200) * 3.0::DOUBLE END AS start_sec,
                  CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 0 THEN (event_id % 200) * 3.0::DOUBLE + event_id % 9 END AS end_sec, (event_id * 37 % 1000) / 1000::DOUBLE AS score, event_id % 3 <> 0 AS has_text, event_id % 2 = 0 OR event_id % 3 = 0 AS has_vector,
                  event_id % 17 = 0 AND event_id % 3 <> 0 AS exact_match, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN (event_id * 53 % 1000) / 1000::DOUBLE END AS similarity, {_sql_pick("user_id", "smart", "video", "audio", "image", "document")} AS preference,
                  CASE WHEN event_id % 13 <> 0 THEN '/m/' || event_id % 50 END AS raw_path, event_id % 5 = 0 AS clip, event_id % 4 = 0 AS preview, event_id % 50 + 1000 AS indexed_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank,
                  trim(regexp_replace(repeat('lorem ' || event_id || '  ', event_id % 70), ' +', ' ', 'g')) AS snippet, CASE WHEN event_id % 4 = 0 THEN event_id % 20 END AS page, CASE WHEN event_id % 4 = 0 THEN 'S' || event_id % 3 END AS section FROM events),
b AS (SELECT *, coalesce(max(CASE WHEN has_text AND NOT has_vector AND score > 0 THEN score END) OVER (PARTITION BY query_id), 0) AS best FROM h),
m AS (SELECT *, CASE WHEN has_text AND NOT has_vector AND best > 0 AND score > 0 THEN least(greatest(score / best * 0.76::DOUBLE, 0), 0.76::DOUBLE) ELSE score END AS base FROM b),
s AS (SELECT *, CASE WHEN exact_match THEN least(greatest(base, 0.92::DOUBLE), 0.98::DOUBLE) WHEN NOT has_text AND has_vector AND coalesce(similarity, base) < 0.52 THEN least(greatest(coalesce(similarity, base) * 0.65::DOUBLE, 0), 0.32::DOUBLE)
                        ELSE least(greatest(base + CASE WHEN has_text THEN 0.03::DOUBLE ELSE 0 END, 0), 0.91::DOUBLE) END AS match_score,
             CASE chunk_type WHEN 'keyframe' THEN 'image' WHEN 'document' THEN 'document' WHEN 'transcript' THEN 'audio' ELSE 'video' END AS chunk_mod FROM m),
k AS (SELECT *, match_score + CASE WHEN exact_match OR match_score < 0.25 THEN 0 WHEN preference = 'smart' THEN CASE WHEN item_type = 'video' THEN 0.06::DOUBLE ELSE 0 END
                                   WHEN CASE WHEN preference = 'video' AND item_type = 'video' THEN 'video' ELSE chunk_mod END = preference THEN 0.12::DOUBLE ELSE 0 END AS boosted FROM s)
"""


def _clock_sql(s: str) -> str:
    return f"CASE WHEN floor({s}) >= 3600 THEN printf('%d:%02d:%02d', floor({s})::BIGINT // 3600, floor({s})::BIGINT // 60 % 60, floor({s})::BIGINT % 60) ELSE printf('%d:%02d', floor({s})::BIGINT // 60, floor({s})::BIGINT % 60) END"


@query(HITS_SQL + "SELECT unit_id, round(match_score, 6) AS match_score FROM s")
def match_scores(spark, sf_dir):
    return R.with_match_scores(_hits(spark, sf_dir).drop("rank")).select("unit_id", F.round("match_score", 6).alias("match_score"))


@query(HITS_SQL + "SELECT unit_id, row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, boosted DESC, match_score DESC, score DESC, playback_chunk_id, unit_id)::INT AS rank FROM k")
def ranked_hits(spark, sf_dir):
    return R.with_rank(R.with_match_scores(_hits(spark, sf_dir).drop("rank"))).select("unit_id", "rank")


@query(HITS_SQL + """,
l AS (SELECT query_id, unit_id, score, exact_match, TRUE AS t, FALSE AS v, NULL::DOUBLE AS similarity, least(1, score + CASE WHEN exact_match THEN 0.25::DOUBLE ELSE 0 END + 0.03::DOUBLE) AS boosted FROM h WHERE has_text
      UNION ALL SELECT query_id, unit_id, similarity, FALSE, FALSE, TRUE, similarity, least(1, similarity) FROM h WHERE has_vector),
f AS (SELECT query_id, unit_id, max_by(score, (boosted, score)) AS score, max(boosted) AS boosted, bool_or(exact_match) AS exact_match, bool_or(t) AS has_text, bool_or(v) AS has_vector FROM l GROUP BY ALL)
SELECT query_id, unit_id, round(score, 6) AS score, exact_match, has_text, has_vector FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, boosted DESC, unit_id) <= 40""")
def fused_candidates(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    queries = hits.select("query_id").distinct().withColumn("limit", F.lit(10))
    lexical = hits.where("has_text").select("query_id", "unit_id", "score", "exact_match")
    fused = R.fuse_candidates(lexical, hits.where("has_vector").select("query_id", "unit_id", "similarity"), queries)
    return fused.select("query_id", "unit_id", F.round("score", 6).alias("score"), "exact_match", "has_text", "has_vector")


@query(HITS_SQL + """
SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'lexical' ELSE 'hybrid' END AS mode, CASE WHEN query_id % 4 = 0 THEN 'no_query_vector' END AS fallback_reason, count(*) FILTER (has_text) AS n_lexical, count(*) FILTER (has_vector) AS n_vector FROM h GROUP BY query_id""")
def search_diagnostics(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    queries = hits.select("query_id").distinct().withColumn("query_vector", F.when(F.col("query_id") % 4 != 0, F.array(F.lit(1.0))))
    return R.search_diagnostics(queries, hits.where("has_text"), hits.where("has_vector"), True)


GROUPS_SQL = HITS_SQL + """,
g AS (SELECT *, CASE WHEN chunk_type = 'document' THEN 'row:' || playback_chunk_id WHEN start_sec IS NULL THEN 'kind:' || chunk_type ELSE 't:' || floor(start_sec / 12)::BIGINT END AS bucket FROM s),
a AS (SELECT query_id, item_id, bucket, min_by(unit_id, rank) AS lead_unit_id, max(match_score) AS best_score, count(*) AS n_hits, list(unit_id ORDER BY rank) AS ids FROM g GROUP BY ALL)
"""


@query(GROUPS_SQL + """
SELECT query_id, item_id, bucket, lead_unit_id, n_hits, array_to_string(ids[2:], ',') AS more, CASE WHEN best_score / max(best_score) OVER (PARTITION BY query_id) >= 0.82 THEN 'high' WHEN best_score / max(best_score) OVER (PARTITION BY query_id) >= 0.48 THEN 'medium' ELSE 'low' END AS confidence FROM a""")
def grouped_hits(spark, sf_dir):
    """Hits by moment, with the rest of each group and how sure the best is."""
    hits = _hits(spark, sf_dir)
    grouped = R.group_hits(R.with_match_scores(hits))
    best = F.max("best_score").over(Window.partitionBy("query_id"))
    return grouped.select("query_id", "item_id", "bucket", "lead_unit_id", "n_hits", F.array_join("more", ",").alias("more"), R.confidence(F.col("best_score"), best).alias("confidence"))


MODALITY_SQL = HITS_SQL + """,
f AS (SELECT query_id, item_id, bool_or(chunk_type = 'document') AS d, bool_or(chunk_type IN ('keyframe', 'understanding', 'moment')) AS s, bool_or(chunk_type IN ('transcript', 'moment')) AS a FROM h GROUP BY ALL),
y AS (SELECT query_id, item_id, CASE WHEN d THEN 'document' WHEN s AND a THEN 'video' WHEN s THEN 'image' ELSE 'audio' END AS modality FROM f)
"""


@query(MODALITY_SQL + """
SELECT query_id, 'modality' AS facet, modality AS value, count(*) AS n FROM y JOIN h USING (query_id, item_id) GROUP BY ALL UNION ALL SELECT query_id, 'source', source_id, count(*) FROM h GROUP BY ALL""")
def facets_of_hits(spark, sf_dir):
    hits = _hits(spark, sf_dir).drop("modality")
    return R.hit_facets(hits.join(R.hit_modality(hits, ["query_id", "item_id"]), ["query_id", "item_id"]))


@query(HITS_SQL + "SELECT unit_id FROM h WHERE source_id = 's-3' AND item_type = 'video' AND start_sec < 600 UNION ALL SELECT unit_id FROM h WHERE source_id = 's-4' AND item_type = 'audio' AND start_sec IS NOT NULL")
def filtered_hits(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return R.filter_hits(hits, "s-3", "video", "under_10").select("unit_id").union(R.filter_hits(hits.where("start_sec is not null"), "s-4", "audio", recent=True).select("unit_id"))


@query(TOKENS_SQL + "x AS (SELECT term, count(*) AS n, count(DISTINCT unit_id) AS units, sum(pos - 1)::BIGINT AS places, sum(dl)::BIGINT AS lengths FROM p GROUP BY term) SELECT * FROM x")
def postings_by_term(spark, sf_dir):
    """Every term of the index, with its postings summed up."""
    return L.term_totals(_index(spark, sf_dir))


@query(r"""
SELECT doc_id AS query_id, 'doc-' || doc_id AS item_id, 'document' AS chunk_type, 'doc-' || doc_id || ':document:000000' AS playback_chunk_id, source AS source_id, left(text, 80) AS item_title FROM documents
WHERE doc_id % 2 = 0 AND regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''""")
def hydrated_hits(spark, sf_dir):
    units, items = _units(spark, sf_dir), A.document_items(spark, sf_dir).withColumn("status", F.when(_number() % 2 == 0, "indexed").otherwise("failed"))
    hits = units.select(F.regexp_extract("item_id", r"(\d+)$", 1).cast("long").alias("query_id"), F.col("id").alias("unit_id"))
    return R.hydrate(hits, units, items, L.searchable_units(units, items)).select("query_id", "item_id", "chunk_type", "playback_chunk_id", "source_id", "item_title")


WHOLE_SQL = TOKENS_SQL.replace("array_to_string(list_slice(regexp_split_to_array(text, '[ \\n]+'), 1, 3), ' ')", "array_to_string(regexp_split_to_array(text, '[ \\n]+'), ' ')")


@query(WHOLE_SQL + r"""
n AS (SELECT query_id, translate(regexp_replace(q, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS needle FROM q)
SELECT n.query_id, unit_id FROM n JOIN d ON contains(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), needle) WHERE needle <> ''
QUALIFY row_number() OVER (PARTITION BY n.query_id ORDER BY unit_id) <= 40""")
def literal_hits_of_texts(spark, sf_dir):
    """Documents that hold the whole text of a benchmark item."""
    return L.literal_search(A.text_queries(spark, sf_dir, None), _index(spark, sf_dir)).select("query_id", "unit_id")


@query(WHOLE_SQL + r"""
qw AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(q, '[^\p{L}\p{N} ]', '', 'g')), '[\p{L}\p{N}]+'))) AS term FROM q),
qt AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS np FROM qw),
m AS (SELECT query_id, np, p.term, unit_id, dl, count(*) AS tf FROM p JOIN qt ON p.term = qt.term GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM m GROUP BY ALL),
sc AS (SELECT m.query_id, unit_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score, count(*) AS met, any_value(np) AS np
       FROM m JOIN df ON m.query_id = df.query_id AND m.term = df.term, st GROUP BY ALL)
SELECT query_id, unit_id, round(score, 5) AS score FROM sc WHERE met = np QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) <= 10""")
def bm25_hits_of_texts(spark, sf_dir):
    """The best ten documents that hold all words of a benchmark item, by a stored index."""
    queries = A.text_queries(spark, sf_dir, None).withColumn("q", F.regexp_replace("q", r"[^\p{L}\p{N} ]", ""))
    units = _index(spark, sf_dir)
    found = L.bm25_search(queries, units, index=L.stored_index(units))
    return found.where("rank <= 10").select("query_id", "unit_id", F.round("score", 5).alias("score"))


def _windows_asked(spark, sf_dir):
    """The windows of every conversation as hits of a query for its first word."""
    rows = C.effective_times(A.media_chunks(spark, sf_dir))
    asked = _turns(spark, sf_dir).groupBy("item_id").agg(F.min_by(F.regexp_extract("text", r"^(\S+)", 1), "turn").alias("q"))
    return C.window_grid(rows).join(asked, "item_id").select("item_id", F.col("item_id").alias("query_id"), F.col("k").cast("string").alias("unit_id"), "q", F.col("window_start").alias("start_sec"), F.col("window_end").alias("end_sec"))


ASKED_SQL = FRAMES_SQL + r""",
q AS (SELECT 'conv-' || conv_id AS item_id, min_by(regexp_extract(text, '^(\S+)', 1), turn) AS q FROM conversations GROUP BY conv_id),
t AS (SELECT 'conv-' || conv_id AS item_id, conv_id, turn, text FROM conversations)
"""


@query(ASKED_SQL + """
SELECT w.item_id, w.k, w.item_id || ':transcript:' || lpad(turn::VARCHAR, 6, '0') AS spoken_id, 12.0::DOUBLE * turn AS spoken_start FROM w JOIN q USING (item_id) JOIN t ON t.item_id = w.item_id AND 12 * turn <= we AND 12 * turn + 12 >= ws
QUALIFY row_number() OVER (PARTITION BY w.item_id, w.k ORDER BY CASE WHEN q <> '' AND contains(lower(text), lower(trim(q, '"'))) THEN 0 ELSE 1 END, turn) = 1""")
def spoken_lines(spark, sf_dir):
    """The turn in every window that answers a query for the conversation's first word."""
    found = R.best_spoken_line(_windows_asked(spark, sf_dir), A.media_chunks(spark, sf_dir)).where("spoken_id is not null")
    return found.select("item_id", F.col("unit_id").cast("int").alias("k"), "spoken_id", "spoken_start")


@query(ASKED_SQL + r"""
SELECT w.item_id, w.k, w.item_id || ':ocr:' || turn AS visual_id, 12.0::DOUBLE * turn + 5 AS visual_start FROM w JOIN q USING (item_id) JOIN t ON t.item_id = w.item_id AND turn % 2 = 0 AND regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> '' AND 12 * turn + 5 >= ws AND 12 * turn + 5 <= we
QUALIFY row_number() OVER (PARTITION BY w.item_id, w.k ORDER BY CASE WHEN q <> '' AND contains(lower(text), lower(trim(q, '"'))) THEN 0 ELSE 1 END, w.item_id || ':ocr:' || turn) = 1""")
def visual_rows(spark, sf_dir):
    """The on-screen text in every window that answers the query."""
    rows = _ocr(spark, sf_dir).unionByName(A.frames(spark, sf_dir), allowMissingColumns=True)
    found = R.best_visual_row(_windows_asked(spark, sf_dir), rows).where("visual_id is not null")
    return found.select("item_id", F.col("unit_id").cast("int").alias("k"), "visual_id", "visual_start")


@query("""
SELECT 'conv-' || c.conv_id AS item_id, c.turn, 'f-' || c.conv_id || '-' || f.turn || '.jpg' AS frame_path, CASE WHEN c.turn % 3 = 0 THEN 12.0::DOUBLE * f.turn + 5 ELSE 12.0::DOUBLE * c.turn + c.turn % 2 * 5 END AS start_sec
FROM conversations c JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 2 = 0) f ON f.conv_id = c.conv_id
QUALIFY row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY abs(12.0 * f.turn + 5 - (12.0 * c.turn + c.turn % 2 * 5)), f.turn DESC) = 1""")
def hits_with_frames(spark, sf_dir):
    """Hits at every turn with the nearest frame, the following one in a tie; on-screen hits start with it."""
    turn = F.col("turn")
    hits = _turns(spark, sf_dir).select("item_id", F.lit(1).alias("query_id"), F.concat("item_id", F.lit("/"), turn.cast("string")).alias("unit_id"), "turn", F.when(turn % 3 == 0, "ocr").otherwise("transcript").alias("chunk_type"), (12.0 * turn + turn % 2 * 5).alias("start_sec"))
    return R.attach_nearest_frame(hits, A.frames(spark, sf_dir)).select("item_id", "turn", "frame_path", "start_sec")


# E

def _enriched(spark, sf_dir):
    sources = spark.range(6).select(F.concat(F.lit("s-"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 2 == 0, F.format_string('{"title":"Source %d"}', "id")).alias("config"), F.lit("folder_video").alias("type"))
    listing = spark.range(0, 50, 2).select(F.concat(F.lit("/m/"), F.col("id").cast("string")).alias("path"))
    return E.enrich_hits(_hits(spark, sf_dir), sources, listing)


ENRICHED_SQL = HITS_SQL + f""",
r AS (SELECT *, CASE WHEN event_id % 7 = 6 THEN 'Unknown source' WHEN event_id % 7 % 2 = 0 THEN 'Source ' || event_id % 7 ELSE 'folder_video' END AS source_name, event_id % 13 <> 0 AND event_id % 2 = 0 AS file_exists,
             CASE WHEN start_sec IS NULL THEN NULL WHEN end_sec IS NULL THEN {_clock_sql("start_sec")} ELSE {_clock_sql("start_sec")} || '-' || {_clock_sql("end_sec")} END AS time_label,
             CASE WHEN length(snippet) > 240 THEN rtrim(left(snippet, 240)) || '...' ELSE snippet END AS quote, CASE WHEN chunk_type = 'document' THEN 'document' WHEN chunk_type = 'keyframe' THEN 'frame' WHEN item_type IN ('video', 'audio') AND start_sec IS NOT NULL THEN 'video_clip' ELSE 'chunk' END AS evidence_kind,
             'item/' || item_id || CASE WHEN start_sec IS NOT NULL THEN '?t=' || floor(start_sec)::BIGINT ELSE '' END AS deep_link FROM h)
"""


@query(ENRICHED_SQL + "SELECT unit_id, source_name, file_exists, time_label, quote, coalesce(page, -1)::BIGINT AS page, section, evidence_kind, deep_link FROM r")
def enriched_hits(spark, sf_dir):
    return _enriched(spark, sf_dir).select("unit_id", "source_name", "file_exists", "time_label", "quote", F.coalesce("page", F.lit(-1)).alias("page"), "section", "evidence_kind", "deep_link")


@query(ENRICHED_SQL + """,
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, CASE WHEN evidence_kind = 'document' THEN concat_ws(', ', 'p. ' || page, section) ELSE time_label END AS place FROM r WHERE quote <> ''),
a AS (SELECT query_id, string_agg(item_title || CASE WHEN place IS NOT NULL AND place <> '' THEN ' (' || place || ')' ELSE '' END || ': ' || quote, ' ' ORDER BY n) AS text, string_agg(unit_id, ',' ORDER BY n) AS citations FROM c WHERE n <= 3 GROUP BY query_id)
SELECT q.query_id, CASE WHEN text IS NULL THEN CASE WHEN q.query_id % 2 = 0 THEN '没有找到相关证据。' ELSE 'No evidence was found for this query.' END ELSE CASE WHEN q.query_id % 2 = 0 THEN '根据资料：' ELSE 'From your library: ' END || text END AS answer, coalesce(citations, '') AS citations
FROM (SELECT DISTINCT user_id AS query_id FROM events UNION ALL SELECT DISTINCT -1 - user_id FROM events) q LEFT JOIN a USING (query_id)""")
def answers_from_hits(spark, sf_dir):
    """Answers to every user's query and to as many without evidence, in two languages."""
    users = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id")).distinct()
    queries = users.union(users.select(-1 - F.col("query_id"))).withColumn("locale", F.when(F.col("query_id") % 2 == 0, "zh-CN").otherwise("en"))
    return E.extractive_answer(queries, _enriched(spark, sf_dir)).select("query_id", "answer", F.array_join("citations", ",").alias("citations"))


@query(HITS_SQL + """
SELECT query_id, count(*) AS n_results, count(DISTINCT item_id) AS n_items, array_to_string(list_filter(['video', 'audio', 'image', 'document'], lambda m: list_contains(list(item_type), m)), ',') AS modalities FROM h GROUP BY query_id""")
def material_summaries(spark, sf_dir):
    return E.material_summary(_hits(spark, sf_dir)).select("query_id", "n_results", "n_items", F.array_join("modalities", ",").alias("modalities"))


@query(HITS_SQL + "SELECT query_id, item_type AS modality, count(DISTINCT item_id) AS n_items, string_agg(unit_id, ',' ORDER BY rank) AS evidence FROM h GROUP BY ALL")
def material_topics(spark, sf_dir):
    return E.material_topics(_hits(spark, sf_dir)).select("query_id", "modality", "n_items", F.array_join("evidence", ",").alias("evidence"))


SHOTS_SQL = HITS_SQL + """,
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM h WHERE raw_path IS NOT NULL AND item_type <> 'document' AND (item_type = 'image' OR end_sec - start_sec > 0.25)),
p AS (SELECT *, printf('shot-%02d', place) AS shot_id FROM z)
"""


@query(SHOTS_SQL + "SELECT unit_id, shot_id, printf('beat-%02d', place) AS beat_id FROM p")
def shots_and_beats(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return E.shot_list(hits).select("unit_id", "shot_id").join(E.storyboard(hits).select("unit_id", F.col("shot_id").alias("beat_id")), "unit_id")


@query(HITS_SQL + "SELECT unit_id FROM h WHERE item_type <> 'document' AND (start_sec IS NOT NULL OR clip OR preview)")
def usable_shots(spark, sf_dir):
    return E.usable_shots(_hits(spark, sf_dir)).select("unit_id")


@query(SHOTS_SQL + """,
o AS (SELECT query_id, place, shot_id FROM p WHERE item_type IN ('video', 'image') AND (clip OR preview) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 3)
SELECT p.query_id, p.shot_id, coalesce(string_agg(o.shot_id, ',' ORDER BY o.place), '') AS candidates FROM p LEFT JOIN o ON o.query_id = p.query_id WHERE p.item_type = 'audio' GROUP BY ALL""")
def broll_gaps(spark, sf_dir):
    """Shots that are only heard, with shots that could be shown."""
    found = E.broll_gaps(E.shot_list(_hits(spark, sf_dir)))
    return found.select("query_id", "shot_id", F.array_join("candidates", ",").alias("candidates"))


TIMELINE_SQL = SHOTS_SQL + """,
c AS (SELECT query_id, CASE WHEN item_type = 'audio' THEN 'Audio' ELSE 'Video' END AS track, place, item_title, raw_path, round(coalesce(start_sec, 0) * 1000)::BIGINT AS source_ms, round(CASE WHEN item_type = 'image' THEN 4.0 ELSE end_sec - start_sec END * 1000)::BIGINT AS duration_ms FROM p),
t AS (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY query_id, track ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ms FROM c)
"""


@query(TIMELINE_SQL + """,
j AS (SELECT query_id, track, '{"name":"' || track || '","clips":[' || string_agg('{"place":' || place || ',"name":"' || item_title || '","media":"' || raw_path || '","source_start":{"value":' || source_ms || ',"rate":1000},"duration":{"value":' || duration_ms || ',"rate":1000},"offset":{"value":' || offset_ms || ',"rate":1000}}', ',' ORDER BY place) || ']}' AS json FROM t GROUP BY query_id, track)
SELECT query_id, '{"tracks":[' || string_agg(json, ',' ORDER BY track DESC) || ']}' AS timeline FROM j GROUP BY query_id""")
def timelines(spark, sf_dir):
    """Every user's shots as a timeline of two tracks."""
    return E.timeline_export(E.shot_list(_hits(spark, sf_dir)))


# Files, lexical candidates, scores and generations

@query("""
SELECT folder, sum((n + 49) // 50)::BIGINT AS files
FROM (SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS folder, doc_id % 6 AS bucket, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY folder""")
def scanned_files(spark, sf_dir):
    """Documents written as text files of at most fifty, found again; an ignored folder and another kind of file are passed by."""
    base = shared_path(spark)
    rows = A.table(spark, sf_dir, "documents").select(F.regexp_replace("text", r"\s+", " ").alias("text"), "source", (F.col("doc_id") % 6).alias("bucket"))
    rows.repartition("source", "bucket").write.option("maxRecordsPerFile", 50).partitionBy("source", "bucket").text(f"{base}/library")
    rows.limit(1).select("text").write.text(f"{base}/library/node_modules")
    rows.limit(1).write.json(f"{base}/library/other")
    found = scan_files(spark, [f"{base}/library"], "document")
    return found.groupBy(F.regexp_extract("raw_path", r"source=([^/]+)/", 1).alias("folder")).agg(F.count("*").alias("files"))


def _lexical_sql(where: str, kind: str) -> str:
    """D4 over the documents that satisfy a condition, for the queries of three words."""
    return rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS toks FROM documents WHERE {where}),
p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
st AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM d),
q AS (SELECT item_id AS query_id, array_to_string(list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 3), ' ') AS q FROM benchmark),
qw AS (SELECT query_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(q, '\s+'), lambda w: array_to_string(regexp_extract_all(lower(w), '[\p{{L}}\p{{N}}]+'), ' ')), lambda t: t <> ''))) AS term FROM q),
qt AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS np FROM qw),
m AS (SELECT query_id, np, p.term, doc_id, dl, count(*) AS tf FROM p JOIN qt ON p.term = qt.term GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM m GROUP BY ALL),
sc AS (SELECT m.query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))) AS score, count(*) AS met, any_value(np) AS np FROM m JOIN df ON m.query_id = df.query_id AND m.term = df.term, st GROUP BY ALL),
b AS (SELECT query_id, doc_id, score, FALSE AS exact_match, 0 AS arm, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {kind}) AS rank FROM sc WHERE met = np QUALIFY rank <= 40),
l AS (SELECT query_id, doc_id, 0.01::DOUBLE AS score, TRUE AS exact_match, 1 AS arm, row_number() OVER (PARTITION BY query_id ORDER BY {kind}) AS rank
      FROM q JOIN d ON contains(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(trim(q), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) QUALIFY rank <= 40),
u AS (SELECT query_id, doc_id, max(score) AS score, bool_or(exact_match) AS exact_match, min((arm, rank)) AS place FROM (SELECT * FROM b UNION ALL SELECT * FROM l) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 5) AS score, exact_match FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, {kind}) <= 40"""


@query(_lexical_sql("TRUE", "doc_id::VARCHAR"))
def lexical_candidates(spark, sf_dir):
    """Words and literals together for the first words of every benchmark item."""
    found = L.lexical_candidates(A.text_queries(spark, sf_dir), _index(spark, sf_dir))
    return found.select("query_id", F.col("unit_id").cast("long").alias("doc_id"), F.round("score", 5).alias("score"), "exact_match")


@query(_lexical_sql("doc_id % 3 <> 0", "'doc-' || doc_id || ':document:000000'"))
def old_chunk_hits(spark, sf_dir):
    """The same among the chunks of documents whose index is of an older version."""
    items = A.document_items(spark, sf_dir).withColumn("search_index_version", F.when(_number() % 3 == 0, 2).otherwise(1))
    found = legacy_chunk_search(A.text_queries(spark, sf_dir), A.document_chunks(spark, sf_dir), items)
    return found.select("query_id", F.regexp_extract("item_id", r"(\d+)$", 1).cast("long").alias("doc_id"), F.round("score", 5).alias("score"), "exact_match")


WORDS = ("alpha one", "beta two", "alpha beta three", "none")


@query(f"""
WITH e AS (SELECT event_id, event_id % 2 = 0 AS two, {_sql_pick("event_id // 2", *WORDS)} AS transcript, CASE WHEN event_id % 5 <> 0 THEN {_sql_pick("event_id // 8", *WORDS)} END AS ocr, CASE WHEN event_id % 7 <> 0 THEN {_sql_pick("event_id // 32", *WORDS)} END AS visual,
                  {_sql_pick("user_id", "smart", "audio", "image", "document", "video")} AS preference FROM events),
f AS (SELECT event_id, two, preference, unnest([{{'k': 0, 'p': 0, 'f': 'transcript', 't': transcript}}, {{'k': 1, 'p': 3, 'f': 'ocr', 't': ocr}}, {{'k': 2, 'p': 2, 'f': 'visual', 't': visual}}]) AS x FROM e),
s AS (SELECT event_id, preference, x, CASE WHEN x.t IS NULL THEN 0 WHEN two THEN CASE WHEN contains(x.t, 'alpha beta') THEN 3 ELSE contains(x.t, 'alpha')::INT + contains(x.t, 'beta')::INT END WHEN contains(x.t, 'alpha') THEN 2 ELSE 0 END AS score,
             CASE WHEN two THEN x.p ELSE -x.k END AS priority,
             CASE WHEN preference IN ('image', 'video') THEN [2, 1, 0][x.k + 1] WHEN preference = 'audio' THEN [0, 2, 1][x.k + 1] WHEN preference = 'document' THEN [0, 2, 1][x.k + 1] ELSE x.k END AS fallback FROM f)
SELECT event_id, x.f AS field, x.t AS text FROM s WHERE x.t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, CASE WHEN score > 0 THEN -priority ELSE fallback END) = 1""")
def answering_fields(spark, sf_dir):
    """Which field of a unit answers a query of one or two terms, or stands in by preference."""
    n = F.col("event_id")
    word = lambda k: _pick(F.floor(n / k), *WORDS)
    none = F.lit(None).cast("string")
    rows = A.table(spark, sf_dir, "events").select("event_id", F.when(n % 2 == 0, "Alpha beta").otherwise("ALPHA").alias("q"), word(2).alias("transcript_text"), F.when(n % 5 != 0, word(8)).alias("ocr_text"), F.when(n % 7 != 0, word(32)).alias("visual_text"), none.alias("summary_text"), none.alias("content_text"), _pick(F.col("user_id"), "smart", "audio", "image", "document", "video").alias("preference"))
    return R.with_best_field(rows).select("event_id", "best_.field", "best_.text")


SIMILAR_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS point_key, greatest(0, least(1, list_cosine_similarity(q.v, e.embedding::DOUBLE[]))) AS similarity FROM q, embeddings e),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_key) AS rank FROM s)
"""


@query(SIMILAR_SQL + """
SELECT query_id, point_key, CASE WHEN point_key % 22 = 0 THEN CASE WHEN point_key % 4 = 0 THEN 0.0001 ELSE 0 END ELSE round(similarity, 6) END::DOUBLE AS score FROM t WHERE point_key % 11 = 0 AND rank > 10""")
def lexical_only_scores(spark, sf_dir):
    """Lexical hits that no vector hit supports, scored by their own points; every second of them has none."""
    vectors = A.unit_vectors(spark, sf_dir)
    queries = A.vector_queries(spark, sf_dir)
    near = V.vector_topk(queries, vectors, 10).join(vectors.select("point_key", "unit_id"), "point_key").select("query_id", "unit_id")
    hits = vectors.where("point_key % 11 = 0").select("unit_id", (F.col("point_key") % 4 == 0).alias("exact_match")).crossJoin(V.query_lists(queries))
    found = V.score_lexical_only(hits, near, queries, vectors.where("point_key % 22 <> 0"))
    return found.select("query_id", F.regexp_extract("unit_id", r"(\d+)$", 1).cast("long").alias("point_key"), F.round("score", 6).alias("score"))


@query(SIMILAR_SQL + "SELECT round(avg(CASE WHEN point_key % 3 <> 0 THEN 1 ELSE 0 END), 6)::DOUBLE AS recall FROM t WHERE rank <= 10")
def recall_of_a_part(spark, sf_dir):
    """The recall of a search over two thirds of the vectors."""
    queries, vectors = A.vector_queries(spark, sf_dir), A.unit_vectors(spark, sf_dir)
    found = J.recall_at_k(V.vector_topk(queries, vectors.where("point_key % 3 <> 0"), 10), V.vector_topk(queries, vectors, 10), 10)
    return found.select(F.round("recall", 6).alias("recall"))


@query(UNITS_SQL + "SELECT 1 AS generation, count(*) AS units, 2 * count(*) AS vectors FROM u")
def published_generation(spark, sf_dir):
    """Moments of all conversations embedded and published as one generation; a second one with vectors of a wrong length is refused."""
    items = A.media_items(spark, sf_dir).select("id", F.col("title").alias("item_title"), F.lit("talks").alias("source_label"))
    units = stored(C.build_timed_units(items, A.media_chunks(spark, sf_dir)).where("unit_kind = 'moment'"))
    base = shared_path(spark)
    V.embed_and_commit_generation(units, lambda: V.hashing_embedder(32), base, 1, 32)
    V.embed_and_commit_generation(units, lambda: V.hashing_embedder(16), base, 2, 32)
    return V.current_generation(spark, base).select("generation", "units", "vectors")


@query()
def hybrid_search_hits(spark, sf_dir):
    """The whole search over all conversations for every first turn: vectors and words fused, ranked and collapsed, with the row that plays and its frame."""
    items = A.media_items(spark, sf_dir)
    chunks = stored(A.media_chunks(spark, sf_dir).unionByName(_ocr(spark, sf_dir), allowMissingColumns=True))
    named = items.select("id", F.col("title").alias("item_title"), F.lit("talks").alias("source_label"))
    units = stored(C.build_timed_units(named, chunks))
    embedder = lambda: V.hashing_embedder(64)
    vectors = stored(V.embed(V.plan_embeddings(units).where("input_kind = 'text'"), embedder))
    asked = A.table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 4), " ").alias("q"))
    plan = asked.select(F.col("query_id").cast("string").alias("point_key"), F.lit("").alias("unit_id"), F.lit("").alias("item_id"), F.lit("text").alias("input_kind"), F.col("q").alias("input"))
    embedded = V.embed(plan, embedder).select(F.col("point_key").cast("long").alias("query_id"), F.col("vector").alias("query_vector"))
    queries = stored(asked.join(embedded, "query_id").withColumns({"limit": F.lit(5), "preference": F.lit("smart"), "locale": F.lit("en")}))
    found = hybrid_search(queries, units, items, vectors, chunks=chunks)
    return found.select("query_id", "rank", "unit_id", "item_id", "playback_chunk_id", "chunk_type", "start_sec", "frame_path", F.round("match_score", 5).alias("match_score"), "snippet")
