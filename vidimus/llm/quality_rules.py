"""Quality rules with thresholds that adapt to each language and source.

Every text is measured once. Each measure of a language and source is summed into a mergeable quantile sketch: counts by
logarithmic bucket with linear steps inside, as in published sketches of bounded relative error. Sketches merge by adding
counts, in any order and with the same result, so a small group takes the merged sketch of its language, or of all. The fences
are read from the quartiles of the sketches and joined back to the measures; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, portions, scratch, small, texts_in_batches, written

# The fixed rules of the contract, which fail a text whatever its source.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Sub-buckets of a power of two, in bits: a quantile is off by at most 2**-9 of its value. Values below 2**9 are exact.
BITS = 8
#: Texts behind a threshold, at least; a smaller group takes the sketch of its language, or of all.
LEAST_TEXTS = 200
#: A text fails beyond so many spreads outside of the middle half of its group.
REACH = 3
#: measure: (what is counted, of how many, least spread, whether it fails below too, how far a single one may lie off), in
#: thousandths. The spread is the distance of the quartiles. A mean of n may stray by the last number over sqrt(n) more.
RULES = {
    "word_length": ("word_chars", "n_words", 500, True, 7_500),
    "symbols": ("n_symbols", "n_words", 100, False, 500),
    "duplicate_lines": ("n_dup_lines", "n_lines", 100, False, 1_000),
    "repeated_words": ("n_repeat_words", "n_words", 70, False, 500),
}
MEASURED = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs only."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, of: np.ndarray, n: int, width: int = 5) -> np.ndarray:
    """By text, the words inside a window that the text holds twice or more; ids: word numbers in order, of: their texts."""
    if len(ids) < width:
        return np.zeros(n, np.int64)
    windows = ids
    for k in range(1, width):
        windows = _numbered(windows[: len(ids) - k], ids[k:])
    starts = np.flatnonzero(of[: len(ids) - width + 1] == of[width - 1 :])
    windows = _numbered(of[starts], windows[starts])
    again = starts[np.bincount(windows)[windows] > 1] if len(starts) else starts
    edges = np.bincount(again, minlength=len(ids) + 1) - np.bincount(again + width, minlength=len(ids) + 1)
    return np.bincount(of, weights=np.cumsum(edges[:-1]) > 0, minlength=n).astype(np.int64)


def measures(texts: pa.Array) -> list[np.ndarray]:
    """The columns of MEASURED for large strings without nulls."""
    n = len(texts)
    pieces = pc.ascii_split_whitespace(texts)
    words, of = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    there = pc.greater(pc.binary_length(words), 0)
    words, of = pc.filter(words, there), pc.filter(of, there).to_numpy()
    lists = pc.split_pattern(texts, "\n")
    lines, line_of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    lines, line_of = pc.filter(lines, there), pc.filter(line_of, there).to_numpy()
    number = lambda x: x.dictionary_encode().indices.to_numpy().astype(np.int64)
    n_lines = np.bincount(line_of, minlength=n)
    distinct = np.unique(np.stack([line_of, number(lines)]), axis=1)[0]
    return [
        np.bincount(of, minlength=n),
        np.bincount(of, weights=pc.utf8_length(words).to_numpy(), minlength=n).astype(np.int64),
        pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(),
        n_lines,
        n_lines - np.bincount(distinct, minlength=n),
        repeated_words(number(words), of, n),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in MEASURED.split(", ")]
    for batch in batches:
        texts = batch.column(3)
        for start, stop in portions(pc.binary_length(texts).to_pylist()):
            part = batch.slice(start, stop - start)
            found = measures(pc.cast(part.column(3), pa.large_string()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, pa.int64()) for x in found)], names=["doc_id", "lang", "source", *names])


def bucket(x: Column) -> Column:
    """The sketch's bucket of a number from 0."""
    shift = F.greatest(F.length(F.bin(x)) - (BITS + 1), F.lit(0))
    return (shift * (1 << BITS) + F.call_function("shiftright", x, shift)).cast("long")


def value(b: Column) -> Column:
    """The middle of a bucket, rounded down."""
    shift = F.greatest(F.floor(b / (1 << BITS)) - 1, F.lit(0)).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return ((b - shift * (1 << BITS)) * step + F.floor(step / 2)).cast("long")


def sketches(values: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, bucket, n) of values (*keys, x): a sketch for each key, pre-aggregated before the shuffle. Union and sum merge them."""
    return values.groupBy(*keys, bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, total, low, high): the numbers of values and the first and third quartile. A key holds at most one row a bucket."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    rows = sketch.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda share: value(F.min(F.when(F.col("upto") * 4 >= F.col("total") * share, F.col("bucket"))))
    return rows.groupBy(*keys).agg(F.first("total").alias("total"), at(1).alias("low"), at(3).alias("high"))


def _values() -> Column:
    """The measures of a text in thousandths; of no words or lines, 0."""
    whole = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(0).cast("long")
    stray = lambda b, off: off / F.sqrt(F.greatest(F.col(b), F.lit(1)))
    return F.array(*(F.struct(F.lit(k).alias("measure"), whole(a, b).alias("x"), stray(b, off).alias("stray")) for k, (a, b, _, _, off) in RULES.items()))


def fences(measured: DataFrame, least: int = LEAST_TEXTS, reach: int = REACH) -> DataFrame:
    """(lang, source, measure, lower, upper, texts) for every language and source of measured (lang, source, values).

    Groups with fewer texts than least take the merged sketch of their language, and then of all texts, however few.
    """
    own = written(sketches(measured.select("lang", "source", F.explode("values").alias("v")).select("lang", "source", "v.measure", "v.x"), ["lang", "source", "measure"]))
    void = F.lit(None).cast("string")
    levels = own.withColumn("to", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), lang.alias("l"), source.alias("s")) for i, (lang, source) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), void), (void, void)])))))
    merged = levels.groupBy("to.level", "to.l", "to.s", "measure", "bucket").agg(F.sum("n").alias("n"))
    known = written(quartiles(merged, ["level", "l", "s", "measure"]))
    groups = own.select("lang", "source", "measure").distinct()
    for i in range(3):
        at = known.where(F.col("level") == i).select(F.col("l").alias(f"l{i}"), F.col("s").alias(f"s{i}"), F.col("measure").alias("m_"), F.struct("total", "low", "high").alias(f"k{i}"))
        same = F.col("measure") == F.col("m_")
        same = same & F.col("lang").eqNullSafe(F.col(f"l{i}")) if i < 2 else same
        same = same & F.col("source").eqNullSafe(F.col(f"s{i}")) if i < 1 else same
        groups = groups.join(small(at) if i else at, same, "left").drop("m_")
    enough = lambda i: F.when(F.col(f"k{i}.total") >= least, F.col(f"k{i}"))
    chosen = groups.select("lang", "source", "measure", F.coalesce(enough(0), enough(1), F.col("k2")).alias("k"))
    rule = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in RULES.items() for x in (k, v[i]))), F.col("measure"))
    spread, below = rule(2), rule(3)
    width = reach * F.greatest(F.col("k.high") - F.col("k.low"), spread)
    return chosen.select("lang", "source", "measure", F.when(below, F.col("k.low") - width).alias("lower"), (F.col("k.high") + width).alias("upper"), F.col("k.total").alias("texts"))


def quality_rules(documents: DataFrame, least: int = LEAST_TEXTS, reach: int = REACH) -> DataFrame:
    """(doc_id, lang, source, the measures, base_failed, failed, kept), one row per row of documents.

    Words are separated by ASCII white space, lines by line feeds; only lines with a word count. base_failed are the fixed
    rules; failed lists the measures that leave the fences of the text's language and source, sorted; kept texts have neither.
    Fences come from all texts that pass the fixed rules; a text that fails them is not measured against fences (failed is
    empty). Null texts count as empty and fail the fixed rules. A null language or source is a group of its own. Rows that
    repeat count as often as they are there. Only doc_id, text, lang and source are read. An empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), bytes_of("text").alias("text"))
    with scratch(documents.sparkSession) as keep:
        measured = texts_in_batches(rows).mapInArrow(_measured, f"doc_id long, lang string, source string, {MEASURED}")
        failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
        measured = keep(written(measured.withColumn("base_failed", failed).withColumn("values", _values())))
        found = fences(measured.where("not base_failed"), least, reach)
        found = found.groupBy("lang", "source").agg(F.collect_list(F.struct("measure", "lower", "upper")).alias("fences"))  # a row a measure
        found = keep(written(found.select(F.col("lang").alias("l_"), F.col("source").alias("s_"), "fences")))
    met = measured.join(small(found, 100_000), F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_")), "left")
    outside = "v.x > f.upper + v.stray or coalesce(v.x < f.lower - v.stray, false)"
    beyond = F.expr(f"array_sort(transform(filter(values, v -> exists(fences, f -> f.measure = v.measure and ({outside}))), v -> v.measure))")
    out = met.withColumn("failed", F.when(F.col("base_failed") | F.col("fences").isNull(), F.expr("cast(array() as array<string>)")).otherwise(beyond))
    return out.select("doc_id", "lang", "source", *(c.split()[0] for c in MEASURED.split(", ")), "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
