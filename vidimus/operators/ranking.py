"""From candidates to ranked, citable hits (D9-D23) and their presentation (D25-D28), for a whole table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import clamp, clock, inferred_preference, limited, or_null, parsed_query, scored_by
from .lexical import hinted, pool, top
from .units import effective_times, interval_overlap_join, nearest_frame_asof, overlaps

# Fixed values of the scoring.
LEXICAL_CEILING, EXACT_LOW, EXACT_HIGH, BEST_INEXACT = 0.76, 0.92, 0.98, 0.91
CONFIDENT, UNSURE_FACTOR, UNSURE_CEILING, LEXICAL_BONUS = 0.52, 0.65, 0.32, 0.03
BOOST_FROM, SMART_BOOST, MODALITY_BOOST = 0.25, 0.06, 0.12
FUSE_EXACT, FUSE_LEXICAL = 0.25, 0.03
PER_ITEM, SAME_MOMENT = 3, 30.0
SNIPPET = 320
#: Columns of a unit that hits need for their snippet and at the end.
TEXTS = ("content_text", "transcript_text", "ocr_text", "visual_text", "summary_text", "unit_metadata")


def fuse_candidates(lexical: DataFrame, vector: DataFrame, queries: DataFrame) -> DataFrame:
    """Lexical (query_id, unit_id, score, exact_match) and vector (query_id, unit_id, similarity) hits as one list.

    Flags are OR-ed; the score is that of the side with the better boosted score; cut at the pool.
    """
    boosted = lambda s, exact, text: F.least(F.lit(1.0), s + F.when(exact, FUSE_EXACT).otherwise(0.0) + F.when(text, FUSE_LEXICAL).otherwise(0.0))
    left = lexical.select("query_id", "unit_id", "score", "exact_match", F.lit(True).alias("has_text"), F.lit(False).alias("has_vector"), F.lit(None).cast("double").alias("similarity"))
    right = vector.select("query_id", "unit_id", F.col("similarity").alias("score"), F.lit(False).alias("exact_match"), F.lit(False).alias("has_text"), F.lit(True).alias("has_vector"), "similarity")
    both = left.unionByName(right).withColumn("boosted", boosted(F.col("score"), F.col("exact_match"), F.col("has_text")))
    merged = both.groupBy("query_id", "unit_id").agg(
        F.max_by("score", F.struct("boosted", "score")).alias("score"), F.max("boosted").alias("boosted"), F.bool_or("exact_match").alias("exact_match"), F.bool_or("has_text").alias("has_text"), F.bool_or("has_vector").alias("has_vector"), F.max("similarity").alias("similarity")
    )
    merged = merged.join(hinted(queries.select("query_id", pool().alias("pool_"))), "query_id")
    return top(merged, F.col("pool_"), F.desc("exact_match"), F.desc("boosted"), F.asc("unit_id")).drop("pool_", "boosted").withColumnRenamed("rank", "hit_rank")


def hydrate(hits: DataFrame, units: DataFrame, items: DataFrame, searchable: DataFrame | None = None) -> DataFrame:
    """Hits with their unit's and item's columns; units that aren't searchable go. Order stays in hit_rank."""
    if searchable is not None:
        hits = hits.join(searchable.select("unit_id"), "unit_id", "left_semi")
    of_unit = units.select(F.col("id").alias("unit_id"), "item_id", "unit_kind", "start_sec", "end_sec", "content_text", "transcript_text", "ocr_text", "visual_text", "summary_text", "representative_chunk_id", "representative_frame_path", F.col("metadata").alias("unit_metadata"))
    of_item = items.select(F.col("id").alias("item_id"), "source_id", F.col("title").alias("item_title"), F.col("content_type").alias("item_content_type"), "indexed_at", "raw_path", F.col("duration_sec").alias("item_duration"))
    out = of_unit.join(hinted(stored(hits)), "unit_id")  # few hits come to the units, not the texts to them
    out = stored(out)
    met = stored(of_item.join(hinted(out.select("item_id").distinct()), "item_id", "left_semi"))
    out = out.join(hinted(met), "item_id")
    return out.withColumn("chunk_type", F.when(F.col("unit_kind") == "summary", "understanding").otherwise(F.col("unit_kind"))).withColumn("playback_chunk_id", F.coalesce("representative_chunk_id", "unit_id"))


#: Fields of a unit in their order, and which of them a query of several terms prefers when they answer it equally well.
FIELDS = {"transcript": 0, "ocr": 3, "visual": 2, "summary": 1}
#: Fields in the order in which they stand in where none answers.
FALLBACKS = {"audio": ("transcript", "summary", "visual", "ocr"), "image": ("visual", "ocr", "summary", "transcript"), "video": ("visual", "ocr", "summary", "transcript"), "document": ("summary", "transcript", "visual", "ocr")}


def with_best_field(hits: DataFrame, q: str = "q", preference: str = "preference") -> DataFrame:
    """best_, struct(text, field): the field that answers the query best, else the content, else a field by preference; cut at 320 characters.

    Steps are columns of their own, so that no text is scored twice.
    """
    parsed, texts = F.col("parsed_"), {f: F.col(f"{f}_") for f in (*FIELDS, "content")}
    many = F.size(parsed["terms"]) > 1
    rows = hits.withColumns({f"{f}_": or_null(f"{f}_text") for f in texts}).withColumn("parsed_", parsed_query(q))
    scored = F.array(*[F.struct(F.when(texts[f].isNotNull(), scored_by(texts[f], parsed)).otherwise(0).alias("score"), F.when(many, p).otherwise(-k).alias("priority"), texts[f].alias("text"), F.lit(f).alias("field")) for k, (f, p) in enumerate(FIELDS.items())])
    rows = rows.withColumn("scored_", F.array_max(scored)).withColumn("content_score_", F.when((F.col("scored_.score") == 0) & texts["content"].isNotNull(), scored_by(texts["content"], parsed)).otherwise(0))
    found = lambda f: F.struct(limited(texts[f], SNIPPET).alias("text"), F.lit(f).alias("field"))
    first = lambda order: F.coalesce(*[F.when(texts[f].isNotNull(), found(f)) for f in order])
    by_kind = first(tuple(FIELDS))
    for kind, order in FALLBACKS.items():
        by_kind = F.when(F.col(preference) == kind, first(order)).otherwise(by_kind)
    answers = F.when(F.col("scored_.score") > 0, F.struct(limited("scored_.text", SNIPPET).alias("text"), F.col("scored_.field").alias("field"))).when(F.col("content_score_") > 0, found("content"))
    bare = F.struct(limited(texts["content"], SNIPPET).alias("text"), F.lit(None).cast("string").alias("field"))
    return rows.withColumn("best_", F.coalesce(answers, by_kind, bare)).drop("parsed_", "scored_", "content_score_", *(f"{f}_" for f in texts))


def snippet_of_best() -> Column:
    """The text of best_; of a video's generated fields only that something is there."""
    hidden = (F.col("item_content_type") == "video") & F.col("best_.field").isin("visual", "summary")
    return F.coalesce(F.when(~F.coalesce(hidden, F.lit(False)), F.col("best_.text")), placeholder())


def placeholder() -> Column:
    """What stands for a text that isn't quoted."""
    kind = F.col("chunk_type")
    seen, told = kind.isin("keyframe", "image", "ocr"), kind == "understanding"
    timed = F.concat(F.when(seen, "Visual frame at ").when(told, "Video understanding at ").otherwise("Search match at "), clock("start_sec", rounded=True))
    return F.coalesce(timed, F.when(seen, "Visual match").when(told, "Video understanding match").otherwise("Search match"))


def best_row(hits: DataFrame, rows: DataFrame, rank: Column, fallback: Column, name: str, meets: Callable[..., Column] = overlaps) -> DataFrame:
    """Of the rows that meet each hit the one with the best text score, ties by rank; if none answers, the first by fallback.

    hits: query_id, unit_id, q, item_id, start_sec, end_sec. Both sides of the interval join and its result are stored: the join reads each
    side many times, and a plan that holds them all as often takes the driver minutes.
    """
    windows = stored(hits.select("item_id", "query_id", "unit_id", parsed_query("q").alias("parsed_"), F.col("start_sec").alias("window_start"), F.col("end_sec").alias("window_end")))
    met = interval_overlap_join(stored(rows.withColumn("rank_", rank).withColumn("fallback_", fallback)), windows, meets=meets)
    met = met.withColumn("score_", scored_by(F.col("text"), F.col("parsed_")))
    order = Window.partitionBy("query_id", "unit_id").orderBy(F.desc("score_"), F.when(F.col("score_") > 0, F.col("rank_")).otherwise(F.col("fallback_")))
    best = stored(met.withColumn("n_", F.row_number().over(order)).where("n_ = 1").select("query_id", "unit_id", F.col("id").alias(f"{name}_id"), F.col("text").alias(f"{name}_row_text"), F.col("eff_start").alias(f"{name}_start")))
    return hits.join(best, ["query_id", "unit_id"], "left")


def _inclusive(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    return F.coalesce(F.coalesce(le, ls) >= rs, F.lit(True)) & F.coalesce(ls <= re, F.lit(True))


def best_spoken_line(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """spoken_id, spoken_row_text and spoken_start: lines before transcripts, by time; rows that only touch the unit count."""
    spoken = chunks.where(F.col("chunk_type").isin("transcript_line", "transcript", "audio") & F.col("start_sec").isNotNull()).withColumn("eff_start", F.col("start_sec")).withColumn("eff_end", F.coalesce("end_sec", "start_sec"))
    rank = F.struct(F.when(F.col("chunk_type") == "transcript_line", 0).otherwise(1).alias("c"), F.col("start_sec").alias("s"), F.col("id").alias("i"))
    return best_row(hits, spoken, rank, rank, "spoken", _inclusive)


def best_visual_row(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """visual_id, visual_row_text and visual_start of OCR and understanding rows; understanding first where none answers."""
    shown = effective_times(chunks, last=False).where(F.col("chunk_type").isin("ocr", "understanding") & or_null("text").isNotNull())
    rank = lambda first: F.struct(F.when(F.col("chunk_type") == first, 0).otherwise(1).alias("c"), F.coalesce("start_sec", F.lit(9.3e18)).alias("s"), F.col("id").alias("i"))
    return best_row(hits, shown, rank("ocr"), rank("understanding"), "visual")


def attach_nearest_frame(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The frame nearest to each hit's start (ties take the following one); OCR and understanding hits start with it. Hits without a time have none."""
    frames = chunks.where(F.col("chunk_type").isin("keyframe", "image") & F.col("frame_path").isNotNull() & F.col("start_sec").isNotNull())
    targets = hits.withColumn("target_id", F.concat_ws("|", F.col("query_id").cast("string"), "unit_id")).withColumn("at", F.col("start_sec"))
    out = nearest_frame_asof(targets, frames, following=True)
    for c in ("frame_id", "frame_path", "frame_start"):
        out = out.withColumn(c, F.when(F.col("at").isNotNull(), F.col(c)))
    snaps = F.col("chunk_type").isin("ocr", "understanding") & F.col("frame_start").isNotNull()
    return out.withColumn("start_sec", F.when(snaps, F.col("frame_start")).otherwise(F.col("start_sec"))).drop("target_id", "at")


def with_evidence(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """D13-D16 for hydrated hits (with q and preference): snippet, the row that plays (its kind and start), and the nearest frame; texts of units are left behind.

    A hit whose on-screen or visual text answers plays from its best visual row, one whose transcript answers from its best
    spoken line, others from the unit's representative.
    """
    found = stored(with_best_field(hits).withColumn("field_", F.col("best_.field")).drop(*TEXTS))
    keys, asked = ["query_id", "unit_id"], ("query_id", "unit_id", "q", "item_id", "start_sec", "end_sec")
    seen = best_visual_row(found.where(F.col("field_").isin("ocr", "visual")).select(*asked), chunks).select(*keys, F.col("visual_id").alias("row_id"), F.col("visual_start").alias("row_start"))
    said = best_spoken_line(found.where("field_ = 'transcript'").select(*asked), chunks).select(*keys, F.col("spoken_id").alias("row_id"), F.col("spoken_start").alias("row_start"))
    found = found.join(seen.unionByName(said), keys, "left").withColumn("playback_chunk_id", F.coalesce("row_id", "playback_chunk_id")).withColumn("start_sec", F.coalesce(F.when(F.col("row_id").isNotNull(), F.col("row_start")), "start_sec"))
    kinds = chunks.select(F.col("id").alias("playback_chunk_id"), F.col("chunk_type").alias("played_"))
    found = found.join(kinds, "playback_chunk_id", "left").withColumn("chunk_type", F.coalesce("played_", "unit_kind"))
    found = attach_nearest_frame(found.drop("row_id", "row_start", "played_", "field_"), chunks)
    return found.withColumn("snippet", snippet_of_best()).drop("best_")


def with_texts(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Ranked hits with the texts of their units; what has a text keeps it."""
    told = units.select(F.col("id").alias("unit_id"), *(F.col("metadata" if c == "unit_metadata" else c).alias(f"{c}_") for c in TEXTS))
    out = hits.join(told, "unit_id", "left")
    return out.withColumns({c: F.coalesce(c, f"{c}_") if c in hits.columns else F.col(f"{c}_") for c in TEXTS}).drop(*(f"{c}_" for c in TEXTS))


def with_match_scores(hits: DataFrame) -> DataFrame:
    """match_score, comparable between lexical and vector hits of a query."""
    lexical_only = F.col("has_text") & ~F.col("has_vector")
    usable = lexical_only & (F.col("score") > 0) & ~F.isnan("score")
    best = F.max(F.when(usable, F.col("score"))).over(Window.partitionBy("query_id"))
    out = hits.withColumn("best_", F.coalesce(best, F.lit(0.0)))
    base = F.when(lexical_only & (F.col("best_") > 0) & (F.col("score") > 0), clamp(F.col("score") / F.col("best_") * LEXICAL_CEILING, 0.0, LEXICAL_CEILING)).otherwise(F.col("score"))
    near = F.coalesce("similarity", base)
    score = (
        F.when(F.col("exact_match"), clamp(base, EXACT_LOW, EXACT_HIGH))
        .when(~F.col("has_text") & F.col("has_vector") & (near < CONFIDENT), clamp(near * UNSURE_FACTOR, 0.0, UNSURE_CEILING))
        .otherwise(clamp(base + F.when(F.col("has_text"), LEXICAL_BONUS).otherwise(0.0), 0.0, BEST_INEXACT))
    )
    return out.withColumn("match_score", score).drop("best_")


def _chunk_modality() -> Column:
    c = F.col("chunk_type")
    return F.when(c.isin("image", "keyframe", "ocr"), "image").when(c == "document", "document").when(c.isin("transcript", "transcript_line", "audio"), "audio").when(c.isin("moment", "understanding", "video"), "video")


def _item_modality() -> Column:
    return F.when(F.col("item_content_type").isin("image", "document", "audio", "video"), F.col("item_content_type"))


def with_rank(hits: DataFrame) -> DataFrame:
    """Rank within the query: exact, then score with the boost of the preferred kind, then scores and id."""
    smart = F.coalesce(_item_modality(), _chunk_modality(), F.lit("video")) == "video"
    explicit = F.when((F.col("preference") == "video") & (_item_modality() == "video"), "video").otherwise(F.coalesce(_chunk_modality(), _item_modality(), F.lit("video")))
    boost = F.when(F.col("exact_match") | (F.col("match_score") < BOOST_FROM), 0.0).when(F.col("preference") == "smart", F.when(smart, SMART_BOOST).otherwise(0.0)).when(explicit == F.col("preference"), MODALITY_BOOST).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("exact_match"), F.desc(F.col("match_score") + boost), F.desc("match_score"), F.desc("score"), "playback_chunk_id", "unit_id")
    return hits.withColumn("rank", F.row_number().over(order))


_HIT = "struct<rank:int,unit_id:string,playback:string,kind:string,start:double,score:double,sim:double,exact:boolean,text:boolean,vec:boolean,n:int>"


def collapse_near_duplicates(hits: DataFrame) -> DataFrame:
    """In rank order, a hit within a kept one's moment of the same item lends it its evidence; at most three of an item stay.

    Duplicates never cross items, so the fold runs inside (query, item), whose rows the candidate pool bounds.
    """
    own = hits.groupBy("query_id", "item_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank").cast("int").alias("rank"), "unit_id", F.col("playback_chunk_id").alias("playback"), F.col("chunk_type").alias("kind"), F.col("start_sec").alias("start"),
        F.col("score").cast("double").alias("score"), F.col("similarity").cast("double").alias("sim"), F.col("exact_match").alias("exact"), F.col("has_text").alias("text"), F.col("has_vector").alias("vec"), F.lit(0).alias("n"),
    ))).alias("rows"))

    def same(a: Column, b: Column) -> Column:
        timed = a["start"].isNotNull() & b["start"].isNotNull()
        return F.when(a["playback"] == b["playback"], True).when((a["kind"] == "document") & (b["kind"] == "document"), False).when(timed, F.abs(a["start"] - b["start"]) < SAME_MOMENT).otherwise(a["kind"] == b["kind"])

    def merged(a: Column, b: Column) -> Column:
        a_vec, b_vec = a["vec"] | a["sim"].isNotNull(), b["vec"] | b["sim"].isNotNull()
        takes = (b_vec & ~a_vec) | (b_vec & a_vec & (b["score"] > a["score"]))
        text = ~a_vec & ~b_vec & b["text"] & a["text"] & (b["score"] > a["score"])
        sim = F.when(b_vec & ~a_vec, b["sim"]).when(takes, F.coalesce(b["sim"], a["sim"])).otherwise(a["sim"])
        return F.struct(
            a["rank"].alias("rank"), a["unit_id"].alias("unit_id"), a["playback"].alias("playback"), a["kind"].alias("kind"), a["start"].alias("start"), F.when(takes | text, b["score"]).otherwise(a["score"]).alias("score"),
            F.when(b["sim"].isNotNull() & (sim.isNull() | (b["sim"] > sim)), b["sim"]).otherwise(sim).alias("sim"), (a["exact"] | b["exact"]).alias("exact"), (a["text"] | b["text"]).alias("text"), (a["vec"] | b["vec"]).alias("vec"), (a["n"] + 1).alias("n"),
        )

    def step(kept: Column, b: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda a: same(a, b)), True).cast("int")
        return F.when(at > 0, F.transform(kept, lambda a, i: F.when(i == at - 1, merged(a, b)).otherwise(a))).when(F.size(kept) < PER_ITEM, F.array_append(kept, b)).otherwise(kept)

    folded = own.select("query_id", "item_id", F.explode(F.aggregate("rows", F.expr(f"cast(array() as array<{_HIT}>)"), step)).alias("h"))
    evidence = folded.select("query_id", F.col("h.unit_id").alias("unit_id"), F.col("h.score").alias("score"), F.col("h.sim").alias("similarity"), F.col("h.exact").alias("exact_match"), F.col("h.text").alias("has_text"), F.col("h.vec").alias("has_vector"), F.col("h.n").alias("n_merged"))
    return hits.drop("score", "similarity", "exact_match", "has_text", "has_vector").join(evidence, ["query_id", "unit_id"])


def finalize(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Scored, ranked, collapsed, scored and ranked again, cut at the limit. hits have preference."""
    kept = collapse_near_duplicates(with_rank(with_match_scores(hits)))
    ranked = with_rank(with_match_scores(kept.drop("rank", "match_score")))
    limits = hinted(queries.select("query_id", F.least(F.greatest(F.coalesce("limit", F.lit(10)), F.lit(1)), F.lit(50)).alias("limit_")))
    return ranked.join(limits, "query_id").where(F.col("rank") <= F.col("limit_")).drop("limit_")


def effective_preference(preference: str = "preference", q: str = "q") -> Column:
    """An explicit preference, else what the query's words ask for, else smart."""
    return F.when(F.col(preference).isNotNull() & (F.col(preference) != "smart"), F.col(preference)).otherwise(inferred_preference(q))


def search_diagnostics(queries: DataFrame, lexical: DataFrame, vector: DataFrame, vectors_ready: bool) -> DataFrame:
    """(query_id, mode, fallback_reason, n_lexical, n_vector): one row a query, also those without hits."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    out = queries.select("query_id", "query_vector").join(count(lexical, "n_lexical"), "query_id", "left").join(count(vector, "n_vector"), "query_id", "left")
    reason = F.when(F.lit(not vectors_ready), "vectors_not_ready").when(F.col("query_vector").isNull(), "no_query_vector")
    return out.select("query_id", F.when(reason.isNull(), "hybrid").otherwise("lexical").alias("mode"), reason.alias("fallback_reason"), F.coalesce("n_lexical", F.lit(0)).alias("n_lexical"), F.coalesce("n_vector", F.lit(0)).alias("n_vector"))


def group_hits(hits: DataFrame, seconds: float = 12.0) -> DataFrame:
    """(query_id, item_id, bucket, lead_unit_id, best_score, n_hits, more): moments of 12 s, documents by row, untimed hits by kind."""
    bucket = F.when(F.col("chunk_type") == "document", F.concat(F.lit("row:"), "playback_chunk_id")).when(F.col("start_sec").isNull(), F.concat(F.lit("kind:"), "chunk_type")).otherwise(F.concat(F.lit("t:"), F.floor(F.col("start_sec") / seconds).cast("string")))
    grouped = hits.groupBy("query_id", "item_id", bucket.alias("bucket")).agg(F.min_by("unit_id", "rank").alias("lead_unit_id"), F.max("match_score").alias("best_score"), F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.struct("rank", "unit_id"))).alias("all"))
    return grouped.withColumn("more", F.transform(F.slice("all", 2, 1000), lambda s: s["unit_id"])).drop("all")


def confidence(score: Column, best: Column) -> Column:
    """By the ratio to the best score."""
    ratio = F.when(best > 0, score / best).otherwise(F.lit(0.0))
    return F.when(ratio >= 0.82, "high").when(ratio >= 0.48, "medium").otherwise("low")


def hit_modality(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, modality): document; video if shown and spoken; else image or audio."""
    kind = F.col("chunk_type")
    shown, spoken = kind.isin("image", "keyframe", "ocr", "understanding", "moment"), kind.isin("transcript", "transcript_line", "audio", "moment")
    flags = hits.groupBy(*keys).agg(F.bool_or(kind == "document").alias("d"), F.bool_or(shown).alias("s"), F.bool_or(spoken).alias("a"))
    return flags.select(*keys, F.when(F.col("d"), "document").when(F.col("s") & F.col("a"), "video").when(F.col("s"), "image").when(F.col("a"), "audio").otherwise("video").alias("modality"))


def length_bucket(seconds: Column) -> Column:
    return F.when(seconds.isNull(), None).when(seconds < 600, "under_10").when(seconds < 1800, "10_to_30").otherwise("over_30")


def hit_facets(hits: DataFrame) -> DataFrame:
    """(query_id, facet, value, n) by source and by modality in one pass."""
    sets = hits.groupingSets([[F.col("query_id"), F.col("source_id")], [F.col("query_id"), F.col("modality")]], "query_id", "source_id", "modality").agg(F.count("*").alias("n"), F.grouping("modality").alias("g"))
    return sets.select("query_id", F.when(F.col("g") == 1, "source").otherwise("modality").alias("facet"), F.coalesce("source_id", "modality").alias("value"), "n")


def filter_hits(hits: DataFrame, source: str | None = None, modality: str | None = None, start: str | None = None, level: str | None = None, recent: bool = False) -> DataFrame:
    """D28's filters and orders: source, modality, range of the start, confidence; by relevance or recency."""
    out = hits
    for column, value in (("source_id", source), ("modality", modality), ("confidence", level)):
        out = out if value is None else out.where(F.col(column) == value)
    if start is not None:
        out = out.where(length_bucket(F.col("start_sec")) == start)
    return out.orderBy("query_id", *([F.desc("indexed_at")] if recent else []), "rank")

