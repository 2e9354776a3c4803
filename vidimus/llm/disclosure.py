"""Personal data by information-theoretic sanitisation: DataFrame functions only.

Patterns give the protected entities. How strongly a term reveals a kind of entity is their pointwise mutual information
over the whole corpus (documents that hold both, against chance), as a share of the kind's own information content: 1 for
a term that stands in no document without it. Terms at or above the disclosure threshold, with enough documents behind
them, are protected too, in the documents that hold that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, scratch, small, written

# The kinds in their order, the pattern of each, and a cheap pattern that each match contains.
# The patterns say the same as the plain ones but never try a start inside a run that has failed, and never give back.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A term: letters only, of any script, three or more.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}"
LEAST_DOCUMENTS = 10
DISCLOSURE = 0.5
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_BLOCK = 256
#: Texts with added spans up to which those are broadcast; beyond, the join shuffles.
MORE_ROWS = 100_000


def matches(text: str, pattern: str) -> Column:
    """An array of (start, end, found) of the pattern's matches from left to right, in code points.

    The pieces between matches give the positions. They are summed in blocks, so that thousands of matches stay cheap.
    """
    pattern = pattern.replace("\\", "\\\\").replace("'", "\\'")
    one = "named_struct('start', a.at + s.gap, 'end', a.at + s.gap + s.size, 'found', s.found)"
    kind = "struct<start:int,end:int,found:string>"
    return F.expr(
        f"flatten(aggregate(filter(zip_with(regexp_extract_all(`{text}`, '{pattern}', 0), split(`{text}`, '{pattern}', -1),"
        f" (m, p) -> named_struct('found', m, 'gap', length(p), 'size', length(m))), s -> s.found is not null),"
        f" named_struct('at', 0, 'done', cast(array() as array<array<{kind}>>), 'now', cast(array() as array<{kind}>)),"
        f" (a, s) -> named_struct('at', a.at + s.gap + s.size,"
        f" 'done', if(size(a.now) < {_BLOCK - 1}, a.done, array_append(a.done, array_append(a.now, {one}))),"
        f" 'now', if(size(a.now) < {_BLOCK - 1}, array_append(a.now, {one}), cast(array() as array<{kind}>))),"
        f" a -> array_append(a.done, a.now)))"
    )


def base_spans(text: str = "text") -> Column:
    """All base spans of a text that is not null, by start and kind."""
    of_kind = []
    for rank, kind in enumerate(KINDS):
        of_kind.append(F.when(F.col(text).rlike(HINTS[kind]), _spans(text, rank, kind)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))
    return F.array_sort(F.concat(*of_kind))


def _spans(text: str, rank: int, kind: str) -> Column:
    kept = F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(m, kind))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _holds(m: Column, kind: str) -> Column:
    found = m["found"]
    only = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        even = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
        digit = lambda i: F.substr(only, -i, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(1), F.length(only)), F.lit(0), lambda t, i: t + F.when(i % 2 == 1, digit(i)).otherwise(F.element_at(even, digit(i) + 1)))
        return F.when(F.length(only).between(14, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(only).between(10, 15)
    return F.lit(True)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def disclosing_terms(documents: DataFrame, holders: DataFrame, least: int = LEAST_DOCUMENTS, threshold: float = DISCLOSURE) -> DataFrame:
    """(term, kind, strength) of the terms that reveal a kind; holders: text and the kinds found in it. Counts are over all documents."""
    terms = lambda: F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower)))
    kinds = holders.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_kind"))
    # Protected spans themselves are no terms.
    joint = holders.withColumn("text", F.col("rest")).select(terms().alias("term"), "kinds").select("term", F.explode("kinds").alias("kind")).groupBy("term", "kind").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least)
    joint = written(joint)
    wanted = small(written(joint.select("term").distinct()))
    often = documents.select(terms().alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    total = F.lit(documents.count())
    mutual = F.log2(F.col("n_both") * total / (F.col("n_term") * F.col("n_kind")))
    own = F.log2(total / F.col("n_kind"))
    scored = joint.join(often, "term").join(F.broadcast(kinds), "kind").where(own > 0).select("term", "kind", (mutual / own).alias("strength"))
    return scored.where(F.col("strength") >= threshold)


def find(documents: DataFrame, least: int = LEAST_DOCUMENTS, threshold: float = DISCLOSURE) -> DataFrame:
    """All columns of documents, plus base and spans (arrays of start, rank, end, kind), one row per row.

    A null text counts as empty. Positions are code points, ends are exclusive. Spans of kind term are the method's; they
    overlap no base span. Extra columns stay, but for base and spans, which are replaced. Repeated rows are each answered;
    an empty table gives an empty result. Texts are neither shuffled nor stored, but for those of holders of personal data;
    what the method adds depends on the text alone and is joined by its digest.
    """
    whole, key, added = (fresh(c, documents) for c in ("full_", "digest_", "more_"))
    full = documents.drop("base", "spans").withColumn(whole, F.coalesce("text", F.lit("")))
    with scratch(documents.sparkSession) as keep:
        found = full.select(F.col(whole).alias("text")).withColumn("base", base_spans()).where(F.size("base") > 0)
        found = found.withColumn("kinds", F.array_distinct(F.transform("base", lambda s: s["kind"])))
        holders = written(found.select("text", "base", "kinds", cut("text", "base", F.lit(" ")).alias("rest"), F.md5("text").alias("digest_")))
        terms = small(written(disclosing_terms(full.select(F.col(whole).alias("text")), holders, least, threshold).select("term", F.col("kind").alias("of"))))
        # Only texts that hold a term are taken apart, each once.
        words = holders.select("digest_", "kinds", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("rest", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
        with_terms = written(words.join(terms, "term").where(F.array_contains("kinds", F.col("of"))).select(F.col("digest_").alias("d_"), "term").distinct())
        marked = holders.join(small(with_terms.select("d_").distinct()), F.col("digest_") == F.col("d_"), "left_semi")
        # Few rows with much work each: dealt evenly, whatever files they lie in.
        parts = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tokens = marked.repartition(parts, "digest_").select("digest_", "base", F.explode(matches("text", TERM)).alias("m")).select("digest_", "base", "m", F.lower("m.found").alias("t_"))
        hits = tokens.join(small(with_terms), (F.col("digest_") == F.col("d_")) & (F.col("t_") == F.col("term")))
        hits = hits.where(~F.exists("base", lambda s: (s["start"] < F.col("m.end")) & (F.col("m.start") < s["end"])))
        hits = hits.select("digest_", F.struct(F.col("m.start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("m.end").alias("end"), F.lit("term").alias("kind")).alias("span"))
        more = keep(written(hits.groupBy("digest_").agg(F.collect_set("span").alias("more"))))
    out = full.withColumn("base", base_spans(whole))
    out = out.join(small(more.toDF(key, added), MORE_ROWS), F.md5(whole) == F.col(key), "left")
    return out.withColumn("spans", F.when(F.col(added).isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", added)))).drop(whole, key, added)


def cut(text: str, spans: str, mark: Column | None = None) -> Column:
    """The text with each span replaced by its kind in angle brackets, or by mark; overlapping spans are replaced once, by the first."""
    start = F.expr("named_struct('at', 0, 'done', cast(array() as array<string>))")

    def step(a: Column, s: Column) -> Column:
        put = mark if mark is not None else F.concat(F.lit("<"), s["kind"], F.lit(">"))
        piece = F.concat(F.substr(F.col(text), a["at"] + 1, s["start"] - a["at"]), put)
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.array_append(a["done"], piece)).otherwise(a["done"]).alias("done"))

    return F.aggregate(F.col(spans), start, step, lambda a: F.concat(F.array_join(a["done"], ""), F.substr(F.col(text), a["at"] + 1, F.lit(2**31 - 1))))


def sanitise(documents: DataFrame, least: int = LEAST_DOCUMENTS, threshold: float = DISCLOSURE) -> DataFrame:
    """documents with every span of the text generalised to its kind; n_chars, if there, follows. Null texts stay null.

    All other columns stay, whatever their names. Repeated rows are each answered; an empty table gives an empty result.
    """
    names = documents.columns
    held = documents.toDF(*(c if c in ("text", "n_chars") else f"column_{k}" for k, c in enumerate(names)))
    found = find(held, least, threshold)
    found = found.withColumn("text", F.when(F.size("spans") > 0, cut("text", "spans")).otherwise(F.col("text")))
    if "n_chars" in names:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*held.columns).toDF(*names)
