"""Extra columns with the names that operators use inside, whatever their case, and empty tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import prose
from vidimus import llm
from vidimus.llm import chat_format as C
from vidimus.llm import decontaminate, disclosure, license_scan, line_dedup, lm_scoring, mixing, ngram_jaccard, quality_rules, toxicity
from vidimus.llm.fill_in_middle import fill_in_middle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def inside() -> list[str]:
    """Every name that the subpackage and the pipeline put in quotes as a column."""
    folder = Path(llm.__file__).parent
    source = "".join(p.read_text() for p in [*folder.glob("*.py"), Path(corpus_pipeline.__file__)])
    found = set(re.findall(r'"([a-z_][a-z_0-9]*)"', source)) | {"Base", "BASE_", "GONE", "more_", "Digest_", "full", "again_"}
    taken, names = {c.lower() for c in COLUMNS}, []
    for name in sorted(found):
        if name.lower() not in taken:
            taken.add(name.lower())
            names.append(name)
    return names


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"extra {c}").alias(c) for c in inside()))


def rows():
    mail = [(k, f"{prose(12)} mail a{k}@b.co {prose(12)}", "en", "a", 9) for k in range(30)]
    return [*mail, (40, "some words that are said twice in here", "en", "a", 1), (41, "some words that are said twice in here", "en", "b", 1), (42, None, None, None, None), (None, "", "en", "a", 0), (None, prose(30), "de", "b", 0)]


ROWS = rows()
OPERATORS = {
    "jaccard": lambda d, s: ngram_jaccard.ngram_jaccard(d), "mixing": lambda d, s: mixing.mix(d), "find": lambda d, s: disclosure.find(d, least=2), "sanitise": lambda d, s: disclosure.sanitise(d, least=2), "lines": lambda d, s: line_dedup.line_dedup(d),
    "overlaps": lambda d, s: decontaminate.overlaps(d, s.createDataFrame([(1, ROWS[0][1], 1, 2)], "item_id long, text string, item_ int, hashes int")), "decontaminate": lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([(1, ROWS[0][1])], "item_id long, text string")),
    "licenses": lambda d, s: license_scan.license_scan(d), "scores": lambda d, s: lm_scoring.lm_scores(d, lambda c: F.lit(False)), "middle": lambda d, s: fill_in_middle(d), "rules": lambda d, s: quality_rules.quality_rules(d),
    "toxicity": lambda d, s: toxicity.toxicity(d, s.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, of int"), lambda c: F.lit(True)),
}
ONE_EACH = [k for k in OPERATORS if k not in ("overlaps", "decontaminate")]


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    made = OPERATORS[name](frame(spark, ROWS), spark).collect()
    if name in ONE_EACH:
        assert len(made) == len(ROWS)
    if name in ("find", "sanitise", "decontaminate"):
        extra = next(c for c in made[0].asDict() if c.startswith("more"))
        assert {r[extra] for r in made} == {f"extra {extra}"}
    if name == "sanitise":
        assert made[0].asDict().keys() == set(COLUMNS + inside()) and sum("<email>" in (r.text or "") for r in made) == 30
    assert OPERATORS[name](frame(spark, []), spark).collect() == []


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, none = frame(spark, [*ROWS, ROWS[3]]), frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        kept = out.collect()  # the next stage clears what this one left
        assert stage(spark, none, str(tmp_path)).collect() == []
        if name == "mixing":
            break
        assert out.columns == docs.columns
        assert {r.gone for r in kept} == {"extra gone"} if "gone" in out.columns else True
        assert len(kept) == len(ROWS) + (-1 if name == "ngram_jaccard" else 1), name


def test_schemas():
    yes = [
        ({"a": None}, {"properties": {"a": {"type": ["string", "null"]}}}), (3, {"minimum": 3, "maximum": 3}), ("ab1", {"pattern": "^[a-z]+1$", "minLength": 3}), (1, {"anyOf": [{"type": "string"}, {"type": "integer"}]}), (1.0, {"enum": [1]}),
        ([1, 2], {"items": {"type": "integer"}, "maxItems": 2, "uniqueItems": True}), ({"x": {"x": {}}}, {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"x": {"$ref": "#/$defs/n"}}}}}), ({"b": 1}, {"additionalProperties": {"type": "integer"}}),
        (5, {"not": {"type": "string"}, "oneOf": [{"minimum": 4}, {"maximum": 4}]}), ({}, True), ([], {"const": []}),
    ]
    no = [
        ({"a": 1}, {"properties": {"a": {"type": ["string", "null"]}}}), (2, {"minimum": 3}), ("b", {"pattern": "^a"}), (None, {"anyOf": [{"type": "string"}, {"type": "integer"}]}), (True, {"enum": [1]}), (True, {"type": ["integer", "number"]}), ([1, 1.0], {"uniqueItems": True}),
        ({"x": {"x": 1}}, {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"x": {"$ref": "#/$defs/n"}}}}}), (1, {"$ref": "#"}), (1, {"$ref": "#/nowhere"}), ({"b": 1}, {"additionalProperties": False}), (4, {"oneOf": [{"minimum": 4}, {"maximum": 4}]}), (1, False),
        ("a", {"pattern": "("}), (3, {"minimum": "x"}), (1, {"type": [{}]}), ([1], {"const": [True]}), (3, {"exclusiveMaximum": 3}),
    ]
    assert [C.satisfies(v, s) for v, s in yes] == [True] * len(yes) and [C.satisfies(v, s) for v, s in no] == [False] * len(no)
