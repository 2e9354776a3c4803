"""Retrieval units (C1-C13): evidence that falls in the same stretch of time becomes one unit with a bounded text.

All items are built in one job. Interval joins go through time bins on the item and the bin, so there is no nested loop;
a pair is kept only in the first bin that both sides share, so nothing needs to be deduplicated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import collapsed, json_text, limited, or_null
from ..schemas import SEARCH_INDEX_VERSION

WINDOW, STEP = 30.0, 25.0
BUDGETS = {"transcript": 3200, "ocr": 1200, "visual": 1000, "summary": 3200, "content": 800}
TRANSCRIPT_BUDGET, SUMMARY_BUDGET, OCR_BUDGET, VISUAL_BUDGET = 3200, 3200, 1200, 1000
#: Rows and windows that span so many bins are joined by dyadic nodes.
MOST_BINS = 8
#: Nodes of the highest level are 2**TOP bins wide, 16 years; what is longer has several of them.
TOP = 24
TYPE_ORDER = ("transcript_line", "transcript", "audio", "ocr", "understanding", "keyframe")
EXIF_KEYS = ("Image Make", "Image Model", "EXIF DateTimeOriginal", "GPS GPSLatitude")


def type_rank(c: Column | str = "chunk_type") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(TYPE_ORDER))
    for k, name in reversed(list(enumerate(TYPE_ORDER))):
        out = F.when(c == name, k).otherwise(out)
    return out


def chunk_order() -> Column:
    """A sortable value: start (nulls last), kind of chunk, id."""
    return F.struct(F.coalesce("start_sec", F.lit(9.3e18)).alias("at"), type_rank().alias("rank"), F.col("id").alias("id"))


def effective_times(chunks: DataFrame, last: bool = True) -> DataFrame:
    """eff_start and eff_end; a row without a start has that of the frame with its path: the last in order when building, the first when querying."""
    frames = chunks.where(F.col("chunk_type").isin("keyframe", "image") & F.col("frame_path").isNotNull() & F.col("start_sec").isNotNull())
    pick = F.max_by if last else F.min_by
    times = frames.groupBy("item_id", "frame_path").agg(pick("start_sec", chunk_order()).alias("frame_start_"))
    out = chunks.join(times, ["item_id", "frame_path"], "left")
    start = F.coalesce("start_sec", "frame_start_")
    return out.withColumn("eff_start", start).withColumn("eff_end", F.coalesce("end_sec", start)).drop("frame_start_")


def overlaps(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """C5's predicate. Half-open; an empty row is inclusive at both ends; open ends have forms of their own; a missing start matches."""
    return (
        F.when(ls.isNull() | rs.isNull(), True)
        .when(le.isNotNull() & re.isNotNull() & (F.abs(le - ls) < 2.3e-16), (ls >= rs) & (ls <= re))
        .when(le.isNotNull() & re.isNotNull(), (ls < re) & (le > rs))
        .when(re.isNotNull(), (ls >= rs) & (ls <= re))
        .when(le.isNotNull(), (le >= rs) & (ls <= rs))
        .otherwise(F.abs(ls - rs) < WINDOW)
    )


def _nodes(low: str, high: str) -> Column:
    """The dyadic nodes that make up the bins from low to high, struct(level, node): at most two a level, and at level TOP what is left."""

    def of_level(level: Column) -> Column:
        begin, end = -F.call_function("shiftright", -F.col(low), level), F.call_function("shiftright", F.col(high) + 1, level)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        left, right = F.when((begin < end) & odd(begin), begin), F.when((begin < end) & odd(end), end - 1)
        rest = F.when((level == TOP) & (begin < end), F.sequence(begin, F.greatest(begin, end - 1)))
        return F.transform(F.coalesce(rest, F.array_compact(F.array(left, right))), lambda n: F.struct(level.alias("level"), n.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP)), of_level))


def _above(node: str) -> Column:
    """A node's own place and its ancestors', up to the level TOP."""
    level, at = F.col(f"{node}.level"), F.col(f"{node}.node")
    return F.transform(F.sequence(level, F.lit(TOP)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", at, k - level).alias("node")))


def _far(rows: DataFrame, windows: DataFrame, same: Column, meets: Column) -> DataFrame:
    """Pairs of rows (low_, high_) and windows (first_, last_) of one item by dyadic nodes: of two intervals that share a bin one has a node that
    holds a node of the other. Every pair is met at its first common bin only, so the work grows with the pairs that share bins."""
    ours = rows.withColumn("node_r_", F.explode(_nodes("low_", "high_")))
    theirs = windows.withColumn("node_w_", F.explode(_nodes("first_", "last_")))
    held = windows.columns
    first = F.greatest("low_", "first_")
    covers = lambda n: F.call_function("shiftright", first, F.col(f"{n}.level")) == F.col(f"{n}.node")
    once = covers("node_r_") & covers("node_w_") & meets
    wider = ours.withColumn("key_", F.col("node_r_")).join(theirs.withColumn("key_w_", F.explode(_above("node_w_"))), same & (F.col("key_") == F.col("key_w_")) & once)
    narrower = ours.withColumn("key_", F.explode(_above("node_r_"))).where("key_.level > node_r_.level").join(theirs.withColumn("key_w_", F.col("node_w_")), same & (F.col("key_") == F.col("key_w_")) & once)
    return wider.unionByName(narrower).select(*rows.columns, *held)


def interval_overlap_join(rows: DataFrame, windows: DataFrame, times: tuple[str, str] = ("eff_start", "eff_end"), by: tuple[str, str] = ("window_start", "window_end"), width: float = WINDOW, meets: Callable[..., Column] = overlaps) -> DataFrame:
    """Rows with every window of the same item_id that they overlap (or meet by another predicate that shares a bin); windows' item_id is dropped.

    Short rows meet short windows in their bins. Longer ones are laid out in dyadic nodes, a few a level, and meet the others of
    their items there. Only rows and windows without a start meet an item's whole other side, as all of those pairs count.
    Which of these there are is looked up first, in one pass over both sides: a join of none is left out, as each costs the driver a dozen stages.
    """
    bin_of = lambda t: F.floor(t / width)
    ls, le, rs, re = *(F.col(c) for c in times), *(F.col(c) for c in by)
    rows = rows.withColumn("low_", bin_of(ls)).withColumn("high_", F.greatest(bin_of(ls), bin_of(F.coalesce(le, ls))))
    windows = windows.withColumnRenamed("item_id", "item_").withColumn("first_", bin_of(F.when(re.isNull(), rs - width).otherwise(rs))).withColumn("last_", F.greatest(bin_of(rs), bin_of(F.coalesce(re, rs + width))))
    same, met = F.col("item_id") == F.col("item_"), meets(ls, le, rs, re)
    short, narrow = F.col("high_") - F.col("low_") < MOST_BINS, F.col("last_") - F.col("first_") < MOST_BINS
    placed, cut = rows.where(ls.isNotNull()), windows.where(rs.isNotNull())
    binned = placed.where(short).withColumn("bin_", F.explode(F.sequence("low_", "high_")))
    dealt = cut.where(narrow).withColumn("bin_w_", F.explode(F.sequence("first_", "last_")))
    near = binned.join(dealt, same & (F.col("bin_") == F.col("bin_w_")) & (F.col("bin_") == F.greatest("low_", "first_")) & met).drop("bin_", "bin_w_")
    long, broad = placed.where(~short), cut.where(~narrow)
    none = F.lit(None).cast("boolean")
    kinds = rows.select((~short).alias("long"), ls.isNull().alias("open"), none.alias("broad"), none.alias("endless")).unionByName(windows.select(none.alias("long"), none.alias("open"), (~narrow).alias("broad"), rs.isNull().alias("endless")))
    there = kinds.agg(*(F.bool_or(c).alias(c) for c in kinds.columns)).first()
    among = lambda df, mine, other, theirs: df.join(other.select(F.col(theirs).alias("among_")).distinct(), F.col(mine) == F.col("among_"), "left_semi")
    met_by = [near]
    if there.long:
        met_by.append(_far(long, among(cut, "item_", long, "item_id"), same, met))
    if there.broad:
        met_by.append(_far(among(placed.where(short), "item_id", broad, "item_"), broad, same, met))
    if there.open:
        met_by.append(rows.where(ls.isNull()).join(windows, same & met))
    if there.endless:
        met_by.append(placed.join(windows.where(rs.isNull()), same & met))
    return reduce(DataFrame.unionByName, met_by).drop("item_", "low_", "high_", "first_", "last_")


def window_grid(chunks: DataFrame) -> DataFrame:
    """(item_id, k, window_start, window_end) every 25 s over 30 s, from the first start to the last end; chunks have effective times."""
    kinds = chunks.where(F.col("chunk_type").isin("transcript", "audio", "ocr", "keyframe", "image"))
    own = F.col("chunk_type").isin("transcript", "audio")
    start = F.when(own, F.col("start_sec")).otherwise(F.col("eff_start"))
    end = F.when(own, F.coalesce("end_sec", "start_sec")).otherwise(F.col("eff_end"))
    spans = kinds.groupBy("item_id").agg(F.min(start).alias("first"), F.max(end).alias("last")).where("first is not null").withColumn("last", F.coalesce("last", F.col("first") + WINDOW))
    # a last end before the first start makes no window
    spans = spans.where("first <= last").withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("last") - F.col("first") - WINDOW) / STEP)))))
    begin = F.col("first") + F.col("k") * STEP
    return spans.select("item_id", F.col("k").cast("int").alias("k"), begin.alias("window_start"), F.least(begin + WINDOW, F.greatest("last", begin + 1)).alias("window_end"))


def unique_lines(texts: Column, budget: int) -> Column:
    """Texts in order, one after another, unless a line equal to the whole text is there already; cut at the budget."""
    step = lambda a, t: F.when(F.array_contains(F.split(a, "\n"), t), a).when(a == "", limited(t, budget)).otherwise(limited(F.concat(a, F.lit("\n"), t), budget))
    return F.aggregate(texts, F.lit(""), step)


def understanding_windows(chunks: DataFrame) -> DataFrame:
    """(item_id, ord, window_start, window_end, visual_text, summary_text): one window for each exactly equal range, the summary last."""
    rows = chunks.where("chunk_type = 'understanding'").withColumn("text", or_null("text")).where("text is not null")
    rows = rows.withColumn("kind", F.coalesce(F.get_json_object("metadata", "$.kind"), F.lit(""))).withColumn("order_", chunk_order())
    is_summary = (F.col("kind") == "summary") | (F.col("start_sec").isNull() & F.col("end_sec").isNull())
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("order_", "text"))), lambda s: s["text"])
    summary = rows.where(is_summary).groupBy("item_id").agg(ordered().alias("texts"))
    summary = summary.select("item_id", F.lit(1 << 30).alias("ord"), F.lit(None).cast("double").alias("window_start"), F.lit(None).cast("double").alias("window_end"), F.lit(None).cast("string").alias("visual_text"), unique_lines(F.col("texts"), SUMMARY_BUDGET).alias("summary_text"))
    timed = rows.where(~is_summary).withColumn("priority", F.when(F.col("kind") == "event", 2).when(F.col("kind") == "chapter", 1).otherwise(0))
    key = ["item_id", "start_sec", "end_sec"]
    best = Window.partitionBy(*key)
    timed = timed.withColumn("best_", F.max("priority").over(best)).withColumn("seen_", F.min("order_").over(best)).where("priority = best_")
    merged = timed.groupBy(*key).agg(ordered().alias("texts"), F.min("seen_").alias("seen_"))
    merged = merged.select("item_id", (F.row_number().over(Window.partitionBy("item_id").orderBy("seen_")) - 1).alias("ord"), F.col("start_sec").alias("window_start"), F.col("end_sec").alias("window_end"), F.when(F.size("texts") == 1, F.element_at("texts", 1)).otherwise(unique_lines(F.col("texts"), VISUAL_BUDGET)).alias("visual_text"), F.lit(None).cast("string").alias("summary_text"))
    return merged.union(summary)


def visual_only_windows(chunks: DataFrame) -> DataFrame:
    """C4: (item_id, ord, window_start, window_end) of the frames, else of the OCR rows; for items whose evidence has no start."""
    kinds = chunks.where(F.col("chunk_type").isin("keyframe", "image", "ocr")).withColumn("frame_", F.when(F.col("chunk_type") == "ocr", 1).otherwise(0))
    first = kinds.groupBy("item_id").agg(F.min("frame_").alias("use_"))
    used = kinds.join(first, "item_id").where("frame_ = use_")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(chunk_order())) - 1
    end = F.coalesce(F.when(F.col("frame_") == 0, F.col("end_sec")).otherwise(F.col("eff_end")), F.col("eff_start") + WINDOW)
    return used.select("item_id", place.alias("ord"), F.col("eff_start").alias("window_start"), end.alias("window_end"))


def budgeted_text(rows: DataFrame, keys: list[str], order: Column, budget: int, name: str) -> DataFrame:
    """(keys, name): stripped texts in order joined by a space and cut; rows beyond the budget are left out before any is collected."""
    rows = rows.withColumn("text", or_null("text")).where("text is not null").withColumn("order_", order)
    before = F.sum(F.length("text") + 1).over(Window.partitionBy(*keys).orderBy("order_").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("before_", F.coalesce(before, F.lit(0))).where(F.col("before_") < budget)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("order_", "text"))), lambda s: s["text"])
    return kept.groupBy(*keys).agg(or_null(collapsed(limited(F.array_join(listed, " "), budget))).alias(name)).where(F.col(name).isNotNull())


def nearest_frame_asof(targets: DataFrame, frames: DataFrame, following: bool = False) -> DataFrame:
    """Targets (item_id, target_id, at) with frame_id, frame_path and frame_start of the frame nearest in time.

    An exact tie takes the earlier frame, or the following one. A target without a time, or whose item has no timed frame, takes
    the item's first frame. Both sides are dealt to ranges of item and time, so an item of any size spreads over tasks; the frames
    before and after come from two windows within a range, and the last and first frames of an item's ranges are handed on to its others.
    """
    spark = targets.sparkSession
    value = F.struct(F.col("start_sec").alias("s"), F.col("id").alias("id"), F.col("frame_path").alias("path"))
    empty = F.lit(None).cast("struct<s:double,id:string,path:string>")
    timed = targets.where("at is not null").select("item_id", F.col("at").cast("double").alias("at"), F.lit(1).alias("side"), empty.alias("frame"), F.struct(*targets.columns).alias("row"))
    # among frames of one time the first in order
    marks = frames.where("start_sec is not null").groupBy("item_id", F.col("start_sec").cast("double").alias("at")).agg(F.min(value).alias("frame"))
    both = marks.select("item_id", "at", F.lit(0).alias("side"), "frame", F.lit(None).cast(timed.schema["row"].dataType).alias("row")).unionByName(timed)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(both.repartitionByRange(parts, "item_id", "at", "side").withColumn("part", F.spark_partition_id()))
    # An item that lies in several ranges: at most two such items begin or end in a range.
    edges = ranged.groupBy("item_id", "part").agg(F.max("frame").alias("last"), F.min("frame").alias("first"))
    several = edges.groupBy("item_id").agg(F.collect_list(F.struct("part", "first", "last")).alias("parts")).where("size(parts) > 1")
    over = several.select("item_id", "parts", F.explode("parts.part").alias("part"))
    handed = over.select(F.col("item_id").alias("item_"), F.col("part").alias("part_"), F.expr("array_max(transform(filter(parts, p -> p.part < part), p -> p.last))").alias("earlier"), F.expr("array_min(transform(filter(parts, p -> p.part > part), p -> p.first))").alias("later"))
    by_time = Window.partitionBy("part", "item_id").orderBy("at", "side")
    before = F.last("frame", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("frame", ignorenulls=True).over(by_time.rowsBetween(1, Window.unboundedFollowing))
    found = ranged.withColumn("b", before).withColumn("a", after).where("side = 1").join(F.broadcast(handed), (F.col("item_id") == F.col("item_")) & (F.col("part") == F.col("part_")), "left")
    found = found.select("item_id", "at", "row", F.coalesce("b", "earlier").alias("b"), F.coalesce("a", "later").alias("a"))
    closer = (F.col("at") - F.col("b.s")) - (F.col("a.s") - F.col("at"))
    use_after = F.col("b").isNull() | (F.col("a").isNotNull() & ((closer >= 0) if following else (closer > 0)))
    found = found.select("row", F.when(use_after, F.col("a")).otherwise(F.col("b")).alias("frame"))
    out = found.unionByName(targets.where("at is null").select(F.struct(*targets.columns).alias("row"), empty.alias("frame")))
    # Only rows without a frame look for their item's first; the keys of the others are spread.
    first = frames.groupBy("item_id").agg(F.min_by(value, F.struct(F.col("start_sec").isNull(), "start_sec", "id")).alias("first_")).select(F.concat(F.lit("i"), "item_id").alias("key_"), "first_")
    key = F.when(F.col("frame").isNull(), F.concat(F.lit("i"), F.col("row.item_id"))).otherwise(F.concat(F.lit("-"), F.xxhash64("row").cast("string")))
    out = out.withColumn("key_", key).join(first, "key_", "left").withColumn("frame", F.coalesce("frame", "first_"))
    return out.select("row.*", F.col("frame.id").alias("frame_id"), F.col("frame.path").alias("frame_path"), F.col("frame.s").alias("frame_start"))


def source_label(config: str = "config", kind: str = "type") -> Column:
    return F.coalesce(json_text(config, "title", "name", "url", "feed_url", "channel_url"), F.col(kind))


def content_text(start: str = "start_sec", end: str = "end_sec") -> Column:
    """Labelled lines of what there is."""
    time = lambda c: F.coalesce(F.format_string("%.1fs", F.col(c)), F.lit("?"))
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws(
        "\n", line("Title", limited(or_null("item_title"), 300)), line("Source", limited(or_null("source_label"), 300)),
        F.when(F.col(start).isNotNull() | F.col(end).isNotNull(), F.concat(F.lit("Time: "), F.when(F.col(start).isNull(), "?").otherwise(time(start)), F.lit("-"), F.when(F.col(end).isNull(), "?").otherwise(time(end)))),
        line("Transcript", F.col("transcript_text")), line("On-screen text", F.col("ocr_text")), line("Visual context", F.col("visual_text")), line("Topics/Summary", F.col("summary_text")),
    )


UNIT_COLUMNS = ("id", "item_id", "unit_index", "unit_kind", "start_sec", "end_sec", "content_text", "transcript_text", "ocr_text", "visual_text", "summary_text", "representative_chunk_id", "representative_frame_path", "index_version", "metadata")


def finished(units: DataFrame, items: DataFrame) -> DataFrame:
    """Ids, labels and the content text; items: id, item_title, source_label."""
    named = items.select(F.col("id").alias("item_id"), "item_title", "source_label")
    out = units.join(named, "item_id").withColumn("id", F.format_string("%s:unit:%06d", "item_id", "unit_index")).withColumn("content_text", content_text())
    return out.withColumn("index_version", F.lit(SEARCH_INDEX_VERSION)).select(*UNIT_COLUMNS)


def timed_windows(chunks: DataFrame) -> DataFrame:
    """(item_id, unit_index, window_start, window_end, visual_text, summary_text) of C2, C3 and C4 in their order."""
    text = F.lit(None).cast("string")
    known = understanding_windows(chunks)
    grid = window_grid(chunks).select("item_id", (F.col("k") + F.lit((1 << 30) + 1)).alias("ord"), "window_start", "window_end", text.alias("visual_text"), text.alias("summary_text"))
    both = known.unionByName(grid)
    bare = visual_only_windows(chunks.join(both.select("item_id").distinct(), "item_id", "left_anti")).withColumn("visual_text", text).withColumn("summary_text", text)
    both = both.unionByName(bare)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("ord")) - 1
    return both.withColumn("unit_index", place).drop("ord")


def build_timed_units(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Moments, summaries, and image units for the frames that no moment covers. items: id, item_title, source_label."""
    chunks = stored(effective_times(chunks))
    windows = stored(timed_windows(chunks)).withColumn("summary_only", F.col("summary_text").isNotNull() & F.col("window_start").isNull() & F.col("window_end").isNull())
    key, cut = ["item_id", "unit_index"], windows.where("not summary_only").select("item_id", "unit_index", "window_start", "window_end")
    spoken = chunks.where(F.col("chunk_type").isin("transcript", "audio", "transcript_line"))
    seen = stored(interval_overlap_join(spoken, cut, ("start_sec", "end_sec")))
    order = chunk_order()
    lines = budgeted_text(seen.where("chunk_type = 'transcript_line'"), key, order, TRANSCRIPT_BUDGET, "lines_")
    whole = budgeted_text(seen.where("chunk_type <> 'transcript_line'"), key, order, TRANSCRIPT_BUDGET, "whole_")
    on_screen = stored(interval_overlap_join(chunks.where("chunk_type = 'ocr'"), cut))
    shown = budgeted_text(on_screen.where("eff_start is not null or window_start is null or window_start <= 0"), key, order, OCR_BUDGET, "ocr_text")
    notes = interval_overlap_join(chunks.where("chunk_type = 'understanding'"), cut, ("start_sec", "end_sec"))
    ranked = seen.select(*key, "id", F.struct(F.when(F.col("chunk_type") == "transcript_line", 0).otherwise(1).alias("class"), order.alias("o")).alias("rank"))
    ranked = ranked.union(on_screen.select(*key, "id", F.struct(F.lit(2).alias("class"), order.alias("o")))).union(notes.select(*key, "id", F.struct(F.lit(3).alias("class"), order.alias("o"))))
    shows = ranked.groupBy(*key).agg(F.min_by("id", "rank").alias("best_"))
    firsts = chunks.where("chunk_type <> 'understanding'").groupBy("item_id").agg(
        F.min_by("id", F.struct(F.when(F.col("chunk_type").isin("keyframe", "image"), 0).when(F.col("chunk_type") == "transcript_line", 1).when(F.col("chunk_type") == "ocr", 3).otherwise(2).alias("c"), order.alias("o"))).alias("any_")
    )
    units = windows.join(whole, key, "left").join(lines, key, "left").join(shown, key, "left").join(shows, key, "left").join(firsts, "item_id", "left")
    units = units.withColumn("transcript_text", F.coalesce("whole_", "lines_")).withColumn("visual_text", or_null(limited("visual_text", VISUAL_BUDGET))).withColumn("summary_text", or_null(limited("summary_text", SUMMARY_BUDGET)))
    units = stored(units.where(F.coalesce("transcript_text", "ocr_text", "visual_text", "summary_text").isNotNull()))
    frames = chunks.where(F.col("chunk_type").isin("keyframe", "image"))
    targets = units.where("not summary_only").select("item_id", F.col("unit_index").cast("string").alias("target_id"), F.col("window_start").alias("at"))
    near = nearest_frame_asof(targets, frames).select("item_id", F.col("target_id").cast("int").alias("unit_index"), "frame_id", "frame_path")
    units = units.join(near, key, "left")
    units = units.select(
        *key, F.when(F.col("summary_only"), "summary").otherwise("moment").alias("unit_kind"), F.col("window_start").alias("start_sec"), F.col("window_end").alias("end_sec"), "transcript_text", "ocr_text", "visual_text", "summary_text",
        F.when(F.col("summary_only"), F.col("any_")).otherwise(F.coalesce("best_", "frame_id")).alias("representative_chunk_id"), F.when(~F.col("summary_only"), F.col("frame_path")).alias("representative_frame_path"),
        F.when(F.col("summary_only"), '{"window":"summary"}').otherwise('{"window":"timed"}').alias("metadata"),
    )
    units = stored(units)
    moments = units.where("unit_kind <> 'summary'").select("item_id", "unit_index", F.col("start_sec").alias("window_start"), F.col("end_sec").alias("window_end"))
    covered = interval_overlap_join(frames, moments).select("id").distinct()
    # the largest kept index, or none
    after = units.groupBy("item_id").agg((F.max("unit_index") + 1).alias("next_"))
    left = frames.join(covered, "id", "left_anti").join(after, "item_id", "left").withColumn("place_", F.row_number().over(Window.partitionBy("item_id").orderBy(order)) - 1)
    images = left.withColumn("unit_index", F.coalesce("next_", F.lit(0)) + F.col("place_"))
    return finished(units.unionByName(image_rows(images)), items)


def image_rows(frames: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    return frames.select(
        "item_id", F.col("unit_index").cast("int").alias("unit_index"), F.lit("image").alias("unit_kind"), "start_sec", "end_sec", text.alias("transcript_text"), text.alias("ocr_text"), or_null(limited("text", VISUAL_BUDGET)).alias("visual_text"),
        exif_summary("metadata").alias("summary_text"), F.col("id").alias("representative_chunk_id"), F.col("frame_path").alias("representative_frame_path"), F.lit('{"window":"image"}').alias("metadata"),
    )


def exif_summary(metadata: str, keys: tuple[str, ...] = EXIF_KEYS) -> Column:
    """C12's summary of the given EXIF keys."""
    return or_null(F.concat_ws("; ", *[F.when(or_null(F.get_json_object(metadata, f"$.exif['{k}']")).isNotNull(), F.concat(F.lit(f"{k}: "), F.get_json_object(metadata, f"$.exif['{k}']"))) for k in keys]))


def build_document_units(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """C11: one unit for each document chunk that isn't blank, with its page and section."""
    rows = chunks.where("chunk_type = 'document'").withColumn("body", or_null("text")).where("body is not null")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(chunk_order())) - 1
    heading = limited(F.regexp_replace(F.trim(F.element_at(F.filter(F.split("body", "\n"), lambda t: F.trim(t) != ""), 1)), r"^#+\s*", ""), 120)
    section = F.coalesce(json_text("metadata", "section"), or_null(heading))
    text = F.lit(None).cast("string")
    units = rows.select(
        "item_id", place.alias("unit_index"), F.lit("document").alias("unit_kind"), "start_sec", "end_sec", collapsed(limited("body", TRANSCRIPT_BUDGET)).alias("transcript_text"), text.alias("ocr_text"), text.alias("visual_text"), text.alias("summary_text"),
        F.col("id").alias("representative_chunk_id"), text.alias("representative_frame_path"), F.to_json(F.struct(F.get_json_object("metadata", "$.page").try_cast("long").alias("page"), section.alias("section"))).alias("metadata"),
    )
    return finished(units, items)


def build_image_units(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """One unit for each image or keyframe row."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(chunk_order())) - 1
    return finished(image_rows(chunks.where(F.col("chunk_type").isin("image", "keyframe")).withColumn("unit_index", place)), items)


def labelled_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    """id, content_type, item_title, source_label."""
    from .chunks import display_title

    known = sources.select(F.col("id").alias("source_id"), source_label().alias("source_label"))
    return items.join(known, "source_id", "left").select("id", "content_type", display_title().alias("item_title"), "source_label")


def build_units(items: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """By kind of item; items for which nothing was built get image units of their frames."""
    named = labelled_items(items, sources)
    of = lambda kind: named.where(kind)
    part = lambda kind: chunks.join(of(kind).select(F.col("id").alias("item_id")), "item_id", "left_semi")
    image, document, timed = "content_type = 'image'", "content_type = 'document'", "content_type not in ('image', 'document')"
    units = build_image_units(of(image), part(image)).unionByName(build_document_units(of(document), part(document))).unionByName(build_timed_units(of(timed), part(timed)))
    bare = named.join(units.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    return units.unionByName(build_image_units(bare, chunks.join(bare.select(F.col("id").alias("item_id")), "item_id", "left_semi")))
