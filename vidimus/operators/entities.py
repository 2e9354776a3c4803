"""Entities and the weekly review (G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, collapsed, slug

# Phrases that are entities wherever they stand, words that break a run, and labels that are none.
PHRASES = ["test-time compute", "retrieval quality", "media memory", "semantic retrieval", "video understanding", "prompt engineering", "agent", "agents"]
BREAKS = {"I", "The", "This", "That", "And", "But"}
NO_ENTITY = {"the", "and", "this", "that", "with", "from", "your", "you"}
LONGEST_RUN = 4


def candidate_labels(text: str = "text", most: int | None = None) -> Column:
    """An array of labels in order: fixed phrases, then runs of two to four capitalised words; with most each label once and at most so many."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    phrases = F.filter(F.array(*map(F.lit, PHRASES)), lambda p: lowered.contains(p))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}'-]"), lambda w: F.octet_length(w) > 1)
    # Other words become line ends, so that a run is what stands between two of them.
    runs = F.regexp_extract_all(F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z]") & ~w.isin(*BREAKS), w).otherwise("\n")), " "), F.lit(rf"[^ \n]+(?: [^ \n]+){{1,{LONGEST_RUN - 1}}}"), F.lit(0))
    labels = F.filter(F.transform(F.concat(phrases, runs), lambda c: normalised_label(c)), lambda c: c.isNotNull())
    if most is None:
        return labels
    low = F.transform(labels, F.lower)
    return F.slice(F.filter(labels, lambda c, i: F.array_position(low, F.lower(c)) == i + 1), 1, most)


def candidate_entities(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """(chunk_id, item_id, ord, label); narrow, built-in functions only."""
    return chunks.select(F.col("id").alias("chunk_id"), "item_id", F.posexplode(candidate_labels("text", most)).alias("ord", "label"))


def normalised_label(c: Column) -> Column:
    """Collapsed, edge punctuation cut; null unless 3 to 80 bytes long and no stop word."""
    label = collapsed(F.regexp_replace(c, r"^[^\p{L}\p{N} -]+|[^\p{L}\p{N} -]+$", ""))
    return F.when(F.octet_length(label).between(3, 80) & ~F.lower(label).isin(*NO_ENTITY), label)


def entity_kind(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[A-Z]"), "person_or_entity").otherwise("topic")


def entity_mentions(items: DataFrame, understandings: DataFrame, chunks: DataFrame, chunk_cap: int | None = None, per_chunk: int | None = None) -> DataFrame:
    """G1: (entity, label, kind, item_id, chunk_id, ordinal): topics and entities of understandings, then candidates of text chunks.

    Newest items first; the ordinal is a sortable value, not a global row number. chunk_cap bounds the chunks
    read and per_chunk the different labels taken of each; by default all are.
    """
    newest = items.select(F.col("id").alias("item_id"), (-F.coalesce("indexed_at", F.lit(0))).alias("age"))
    told = understandings.select("item_id", F.from_json("result", "topics array<string>, events array<struct<entities array<string>>>").alias("r"))
    topics = told.select("item_id", F.posexplode("r.topics").alias("ord", "label"))
    named = told.select("item_id", F.posexplode(F.flatten(F.transform("r.events", lambda e: F.coalesce(e["entities"], F.array().cast("array<string>"))))).alias("ord", "label"))
    told = topics.unionByName(named).select("item_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).alias("arm"), "ord", "label")
    text = chunks.where(F.col("text").isNotNull())
    if chunk_cap is not None:
        text = text.join(newest, "item_id").orderBy("age", "id").limit(chunk_cap).drop("age")
    said = candidate_entities(text, per_chunk).select("item_id", "chunk_id", F.lit(1).alias("arm"), "ord", "label")
    rows = told.unionByName(said).withColumn("label", normalised_label(F.col("label"))).where("label is not null").join(newest, "item_id")
    ordinal = F.struct("arm", "age", "item_id", "chunk_id", "ord")
    return rows.select(slug("label").alias("entity"), "label", entity_kind(F.col("label")).alias("kind"), "item_id", "chunk_id", ordinal.alias("ordinal")).where("entity <> ''")


def dedupe_mentions(mentions: DataFrame) -> DataFrame:
    """The first of each entity, item and chunk."""
    order = Window.partitionBy("entity", "item_id", "chunk_id").orderBy("ordinal")
    return mentions.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def entity_summary(mentions: DataFrame, limit: int | None = 30) -> DataFrame:
    """(entity, label, kind, mentions, items) by mentions and label."""
    out = mentions.groupBy("entity").agg(F.min_by("label", "ordinal").alias("label"), F.min_by("kind", "ordinal").alias("kind"), F.count("*").alias("mentions"), F.count_distinct("item_id").alias("items")).orderBy(F.desc("mentions"), "label", "entity")
    return out if limit is None else out.limit(limit)


def weekly_review(items: DataFrame, positions: DataFrame, mentions: DataFrame, now: int) -> DataFrame:
    """One row: items and seconds indexed in seven days, percent watched, the three most mentioned labels."""
    week = items.where((F.col("indexed_at") >= now - 7 * 86_400) & (F.col("indexed_at") <= now)).select(F.col("id").alias("item_id"), F.coalesce("duration_sec", F.lit(0.0)).alias("d"))
    seen = week.join(positions.select("item_id", "position_sec"), "item_id", "left")
    ratio = F.sum(F.least(F.coalesce("position_sec", F.lit(0.0)), F.col("d"))) / F.nullif(F.sum("d"), F.lit(0.0))
    totals = seen.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("seconds"), F.coalesce(F.least(F.greatest(F.round(100 * ratio), F.lit(0.0)), F.lit(100.0)), F.lit(0.0)).cast("int").alias("watched_percent"))
    top = entity_summary(mentions.join(week, "item_id", "left_semi"), 3)
    topics = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "label"))), lambda s: s["label"]).alias("topics"))
    return totals.join(topics)  # one row each
