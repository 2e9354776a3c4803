"""A training-data pipeline over the table documents: five stages, each one operator, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, further ones
included, whatever their names. Decisions name rows by id and text: null ids are rows of their own, rows that share an id are judged
by their own texts, and rows equal in both are judged alike. Null and empty texts are clean, alone in their group, and stay. An empty
table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidimus.llm import decontaminate, disclosure, mixing, ngram_jaccard, toxicity
from vidimus.llm.common import fresh, left_behind, remove, small, written


def _key() -> Column:
    """A row by its id and its text: decisions name rows, also those without an id and those that share one. Equal rows share a key."""
    return F.xxhash64("doc_id", "text")


def _rows(docs: DataFrame) -> DataFrame:
    """The rows for an operator, with their key as doc_id."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows whose key is in keys (one column, distinct): a broadcast where keys are counted to be few."""
    name = fresh("gone", docs)
    return docs.join(small(written(keys.toDF(name))), _key() == F.col(name), "left_anti")


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage before has been written whole and read again, so the tables it left in the shared folder go first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, left_behind())
        return function(spark, docs, sf_dir)

    run_stage.__doc__ = function.__doc__
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that are likelier toxic than not; learned from all labelled rows that docs still holds. Without any labelled row nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.rated(_rows(docs), *toxicity.train(docs, labels, lambda c: F.lit(True)))
    return _without(docs, scored.where("predicted = 1").select("doc_id").distinct())


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest doc_id (null last), once if its row repeats."""
    groups = written(ngram_jaccard.ngram_jaccard(_rows(docs)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
    ranked = docs.select(_key().alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("rank"))
    several = written(groups.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"))
    members = groups.join(small(several), "component", "left_semi").distinct()
    # Documents that are alone in their group stay without being ranked.
    members = written(members.join(ranked.distinct(), "row"))
    first = members.groupBy("component").agg(F.min(F.struct("rank", "row")).alias("first")).select("component", F.col("first.row").alias("stays"))
    kept = _without(docs, members.select("row").join(first.select(F.col("stays").alias("row")), "row", "left_anti"))
    repeated = written(groups.groupBy("row").count().where("count > 1").select("row"))
    if repeated.isEmpty():
        return kept
    name = fresh("again", docs)
    again = kept.join(small(repeated.toDF(name)), _key() == F.col(name), "left_semi")
    return _without(kept, repeated).unionByName(again.withColumn(name, _key()).dropDuplicates([name]).drop(name))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.overlaps(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id").distinct())


@_stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are generalised in the text."""
    return disclosure.sanitise(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often: (doc_id, source, size, source_size, target, taken, copies)."""
    mixed = mixing.mix(docs).where("taken > 0")
    return mixed.withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("mixing", mix_sources),
]

#: Learned scores have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier: list[str] = []
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = written(out)
        left = left_behind()
        remove(spark, [*earlier, *(x for x in left if x != docs.scratch_path)])
        earlier = [docs.scratch_path]
    return STAGES[-1][1](spark, docs, sf_dir)
