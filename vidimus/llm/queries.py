"""The registered queries of the operators, each over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import disclosure
from .chat_format import chat_format
from .decontaminate import overlaps
from .embedding_dedup import embedding_dedup
from .fill_in_middle import fill_in_middle
from .license_scan import license_scan
from .line_dedup import line_dedup
from .lm_scoring import lm_scores
from .mixing import mix
from .ngram_jaccard import ngram_jaccard
from .quality_rules import quality_rules
from .toxicity import crc, toxicity
from .whitening import whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, disclosure.KINDS), F.sha2(disclosure.listed(F.col("base")), 256).alias("base_sha256"), disclosure.listed(F.col("spans")).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["stop"].cast("string")))
    return found.select("doc_id", "n_units", "n_repeated", "longest_run", "n_passages", "n_removed", F.array_join(spans, ",").alias("removed"))


#: Tools that a conversation may call; a call of another name isn't valid.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"), TOOLS)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join("spans", ","))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), lambda c: crc(c) % 7 == 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: crc(c) % 5 != 0)
    return scored.select("doc_id", (crc("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.array_join("failed", ",").alias("failed"), "kept")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_license_scan": op8_license_scan,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_quality_rules": op12_quality_rules,
    "op13_whitening": op13_whitening,
}

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
  FROM documents),
s AS (
  SELECT *, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
o AS (
  SELECT *, sum(most) OVER w - most AS stopped, (SELECT sum(weight) FROM s) - (sum(weight) OVER w - weight) AS left_weight,
         (SELECT sum(source_size) FROM s) AS total
  FROM s WINDOW w AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT coalesce(max((1.5::DOUBLE * total - stopped::DOUBLE) / left_weight::DOUBLE)
                  FILTER (WHERE (1.5::DOUBLE * total - stopped::DOUBLE) / left_weight::DOUBLE * weight <= most), 0::DOUBLE) AS level
  FROM o),
t AS (
  SELECT source, source_size, least(level * weight, most::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN floor(least(level * weight, most::DOUBLE) / source_size)::BIGINT ELSE 0 END AS times
  FROM s, l),
h AS (SELECT source, draw, sum(size) AS size FROM d GROUP BY source, draw),
c AS (
  SELECT h.source, draw, size, sum(size) OVER (PARTITION BY h.source ORDER BY draw) - size AS before, target - times * source_size AS rest
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT source, draw + CASE WHEN before + size - rest < rest - before THEN 1 ELSE 0 END AS below
  FROM c WHERE before <= rest AND before + size > rest)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (t.times + CASE WHEN d.draw < coalesce(e.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT DISTINCT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.root, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = w.doc_id
"""

EMBEDDING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
r AS (SELECT DISTINCT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(root, vec_id))::BIGINT AS component_id, least(vec_id, coalesce(root, vec_id)) = vec_id AS kept
FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""

LINES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s)(?:[^\n.!?]|[.!?]+[^\x20\x09-\x0D.!?])*(?:[.!?]+[\x20\x09-\x0D]|\n|[.!?]*$)') AS us FROM documents),
u AS (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS k FROM d),
p AS (SELECT doc_id, k, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS e, length(unit) AS size,
             regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM u),
f AS (SELECT doc_id, e - size AS b, e, len(w) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place,
             row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, k) AS occurrence, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS n
      FROM p WHERE len(w) > 0),
r AS (SELECT doc_id, sum(words) AS words FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM f WHERE n > 1) GROUP BY doc_id, run),
l AS (SELECT doc_id, sum(words) AS words, count(*) AS units, min(b)::BIGINT AS b, max(e)::BIGINT AS e
      FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM f WHERE occurrence > 1) GROUP BY doc_id, run HAVING sum(words) >= 8),
fs AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE n > 1) AS n_repeated FROM f GROUP BY doc_id),
rs AS (SELECT doc_id, max(words) AS longest, count(*) FILTER (WHERE words >= 36) AS passages FROM r GROUP BY doc_id),
ls AS (SELECT doc_id, sum(units) AS n_removed, string_agg(b || ':' || e, ',' ORDER BY b) AS spans FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(longest, 0)::BIGINT AS longest_run,
       coalesce(passages, 0)::BIGINT AS n_passages, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS removed
FROM d LEFT JOIN fs USING (doc_id) LEFT JOIN rs USING (doc_id) LEFT JOIN ls USING (doc_id)
"""

#: For the table as given: its messages are plain text, so no call is linked.
CHAT_SQL = """
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(message)) - 1)::BIGINT AS position, 0::BIGINT AS n_calls, 0::BIGINT AS n_valid, 0::BIGINT AS n_answered,
       NULL::BOOLEAN AS linked, message
FROM (SELECT conv_id, turn, json_object('content', coalesce(text, ''), 'role', role)::VARCHAR AS message FROM conversations)
"""

MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle, array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (
  SELECT *, CASE form WHEN 'plain' THEN output
                      WHEN 'psm' THEN split_part(split_part(output, '<S>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<M>', 1), '<S>', 2)
                      ELSE split_part(split_part(output, '<M>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<P>', 1), '<S>', 2) END AS restored FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM r
"""

#: The fences of quality_rules: quartiles from the same buckets, groups under 200 texts merged into their language or into all.
RULES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT k, i, array_to_string(list_slice(w, i, i + 4), ' ') AS five FROM (SELECT k, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
t AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS n FROM g), (SELECT unnest(generate_series(0, 4)) AS j) WHERE n > 1 GROUP BY k),
m AS (
  SELECT k, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(t.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN t USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS (
  SELECT k, lang, source, r.measure, r.spread, r.below, r.off / sqrt(greatest(r.b, 1)) AS stray, CASE WHEN r.b > 0 THEN r.a * 1000 // r.b ELSE 0 END AS x
  FROM (SELECT k, lang, source, unnest([
          {'measure': 'word_length', 'a': word_chars, 'b': n_words, 'spread': 500, 'below': true, 'off': 7500}, {'measure': 'symbols', 'a': n_symbols, 'b': n_words, 'spread': 100, 'below': false, 'off': 500},
          {'measure': 'duplicate_lines', 'a': n_dup_lines, 'b': n_lines, 'spread': 100, 'below': false, 'off': 1000}, {'measure': 'repeated_words', 'a': n_repeat_words, 'b': n_words, 'spread': 70, 'below': false, 'off': 500}]) AS r
        FROM f WHERE NOT base_failed)),
s AS (SELECT lang, source, measure, e * 256 + (x >> e) AS bucket, count(*) AS n FROM (SELECT *, greatest(length(bin(x)) - 9, 0) AS e FROM v) GROUP BY ALL),
z AS (
  SELECT 0 AS level, lang, source, measure, bucket, n FROM s
  UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, measure, bucket, sum(n) FROM s GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM z),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(bucket) FILTER (WHERE upto * 4 >= total) AS b1, min(bucket) FILTER (WHERE upto * 4 >= total * 3) AS b3 FROM u GROUP BY ALL),
y AS (
  SELECT level, lang, source, measure, total, (b1 - e1 * 256) * (1::BIGINT << e1) + (1::BIGINT << e1) // 2 AS low, (b3 - e3 * 256) * (1::BIGINT << e3) + (1::BIGINT << e3) // 2 AS high
  FROM (SELECT *, greatest(b1 // 256 - 1, 0) AS e1, greatest(b3 // 256 - 1, 0) AS e3 FROM q)),
c AS (
  SELECT v.k, v.measure, v.x, v.stray, v.below, coalesce(CASE WHEN a.total >= 200 THEN a.low END, CASE WHEN b.total >= 200 THEN b.low END, o.low) AS low,
         coalesce(CASE WHEN a.total >= 200 THEN a.high END, CASE WHEN b.total >= 200 THEN b.high END, o.high) AS high, v.spread
  FROM v JOIN y a ON a.level = 0 AND a.measure = v.measure AND a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source
         JOIN y b ON b.level = 1 AND b.measure = v.measure AND b.lang IS NOT DISTINCT FROM v.lang JOIN y o ON o.level = 2 AND o.measure = v.measure),
x AS (SELECT k, string_agg(measure, ',' ORDER BY measure) AS failed FROM c
      WHERE x > high + 3 * greatest(high - low, spread) + stray OR (below AND x < low - 3 * greatest(high - low, spread) - stray) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed, '') AS failed, NOT base_failed AND failed IS NULL AS kept
FROM f LEFT JOIN x USING (k)
"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": JACCARD_SQL,
    "op2_embedding_dedup": EMBEDDING_SQL,
    "op3_mixing": MIXING_SQL,
    "op6_line_dedup": LINES_SQL,
    "op7_chat_format": CHAT_SQL,
    "op11_fill_in_middle": MIDDLE_SQL,
    "op12_quality_rules": RULES_SQL,
}
