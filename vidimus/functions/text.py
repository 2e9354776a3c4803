"""Column helpers for text, JSON, times and scores. All are built-in expressions; none needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{L}\p{N}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def or_null(c: Column | str) -> Column:
    """Stripped; blank becomes null."""
    return F.nullif(stripped(c), F.lit(""))


def collapsed(c: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"[\s\p{Z}]+", " "))


def limited(c: Column | str, n: int) -> Column:
    return F.left(col(c), F.lit(n))


def ellipsis(c: Column | str, n: int) -> Column:
    """Collapsed, once; beyond n characters cut to n with three dots."""
    cut = lambda t: F.when(F.length(t) > n, F.concat(F.rtrim(F.left(t, F.lit(n))), F.lit("..."))).otherwise(t)
    return F.transform(F.array(collapsed(c)), cut)[0]


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slug(c: Column | str) -> Column:
    """Lower-case letters and digits, everything between them as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), rf"[^\p{{L}}\p{{N}}]+", "-"), "^-+|-+$", "")


def safe_stem(c: Column | str, n: int = 80) -> Column:
    """A file name's stem: letters, digits, dash and underscore, others as underscore; never empty."""
    stem = F.left(F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), F.lit(n))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("untitled"))


def url_path(c: Column | str) -> Column:
    """Percent-encoded, with spaces as %20 and slashes kept."""
    return F.replace(F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def clean_title(c: Column | str) -> Column:
    """A media title from a file name: no extension, separators as spaces."""
    return collapsed(F.regexp_replace(F.regexp_replace(col(c), r"\.[A-Za-z0-9]{1,5}$", ""), r"[_]+", " "))


def sanitised_error(c: Column | str, home: str = "/Users") -> Column:
    """Home folders as ~."""
    return F.regexp_replace(F.regexp_replace(col(c), rf"{home}/[^/]*/", "~/"), rf"{home}/[^/]*$", "~")


def clock(seconds: Column | str, rounded: bool = False) -> Column:
    """M:SS, or H:MM:SS from an hour on; negative as 0."""
    s = F.greatest(F.lit(0), (F.round(col(seconds)) if rounded else F.floor(col(seconds))).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def seconds_of(label: Column | str) -> Column:
    """The inverse of clock; null for other text."""
    text = F.trim(col(label))
    parts = F.reverse(F.split(text, ":"))
    total = F.aggregate(F.transform(parts, lambda p, i: p.try_cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x)
    return F.when(text.rlike(r"^\d+(:\d{1,2}){1,2}$"), total)


def json_text(c: Column | str, *keys: str) -> Column:
    """The first of the keys whose value isn't blank."""
    return F.coalesce(*[or_null(F.get_json_object(col(c), f"$.{k}")) for k in keys])


def json_number(c: Column | str, *keys: str) -> Column:
    return F.coalesce(*[F.get_json_object(col(c), f"$.{k}").try_cast("double") for k in keys])


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def joined(parts: list[Column], sep: str = "\n") -> Column:
    """The parts that aren't null, one after another."""
    return F.concat_ws(sep, *parts)


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether text contains one of them; ASCII words only as whole tokens."""
    found = F.lit(False)
    for n in needles:
        word = n.isascii() and n.isalnum()
        found = found | (text.rlike(rf"(?<![0-9a-z]){n}(?![0-9a-z])") if word else text.contains(n))
    return found


# Words that name a kind of media in a query, in the order in which they are tried.
PREFERENCES = {
    "document": [".pdf", ".doc", ".docx", ".ppt", ".pptx", "pdf", "docx", "pptx", "文档", "文稿", "报告", "论文"],
    "image": [".jpg", ".jpeg", ".png", ".webp", "图片", "图像", "截图", "照片", "海报"],
    "audio": ["音频", "录音", "播客", "podcast", "语音", "声音", "audio"],
    "video": ["视频", "影片", "录像", "片段", "clip", "video"],
}


def inferred_preference(q: Column | str) -> Column:
    """The kind of media that a query asks for, else smart."""
    text = ascii_lower(stripped(q))
    out = F.lit("smart")
    for kind, words in reversed(PREFERENCES.items()):
        out = F.when(any_of(text, words), kind).otherwise(out)
    return out


def strong_exact_intent(q: Column | str) -> Column:
    """A quoted or specific query, whose literal hits count as exact."""
    text = stripped(q)
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    quoted = text.startswith('"') & text.endswith('"') & (F.octet_length(text) > 2)
    tokens = F.size(F.filter(F.split(text, r"[\s\p{Z}]+"), lambda t: t != ""))
    strong = text.rlike(r"[-_/.#0-9]") | (alnum >= 8) | (text.rlike(r"[\x{4E00}-\x{9FFF}]") & (alnum >= 4)) | (tokens >= 2)
    return F.coalesce((F.octet_length(text) >= 2) & (quoted | strong), F.lit(False))


def query_terms(q: Column | str) -> Column:
    """Lower-case terms of a query, for scoring snippets."""
    text = F.lower(F.regexp_replace(stripped(q), '^"+|"+$', ""))
    return F.filter(F.split(text, r"[\s\p{Z}]+"), lambda t: t != "")


def parsed_query(q: Column | str) -> Column:
    """struct(terms, phrase, total): a query's terms with their weights, 4 with a digit, 3 with punctuation, else 1, and their sum; its whole phrase."""
    weight = lambda t: F.when(t.rlike("[0-9]"), 4).when(t.rlike(r"[^\p{L}\p{N}]"), 3).otherwise(1)
    terms = F.transform(query_terms(q), lambda t: F.struct(t.alias("t"), weight(t).alias("w")))
    phrase = F.lower(F.regexp_replace(stripped(q), '^"+|"+$', ""))
    return F.struct(terms.alias("terms"), phrase.alias("phrase"), F.aggregate(terms, F.lit(0), lambda a, t: a + t["w"]).alias("total"))


def scored_by(text: Column, parsed: Column) -> Column:
    """How well a text answers a parsed query: the weights of its terms; one more than all for the whole phrase."""
    low = F.lower(text)
    by_term = F.aggregate(parsed["terms"], F.lit(0), lambda a, t: a + F.when(low.contains(t["t"]), t["w"]).otherwise(0))
    exact = F.when((parsed["phrase"] != "") & low.contains(parsed["phrase"]), F.greatest(parsed["total"], F.lit(1)) + 1)
    return F.coalesce(exact, by_term, F.lit(0))


def text_score(text: Column, q: Column | str) -> Column:
    return scored_by(text, parsed_query(q))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """D7 as a column: cosine of 1 less the distance, dot as it is, l2 as 1 / (1 + distance); within 0 and 1, non-finite is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    if metric in ("cosine",):
        raw = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    elif metric in ("dot", "ip"):
        raw = dot(a, b)
    elif metric in ("l2", "euclid", "euclidean"):
        raw = 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0))), F.lit(0.0), lambda t, v: t + v)))
    else:
        raise ValueError(f"unknown metric {metric}")
    return F.when(raw.isNull() | F.isnan(raw), 0.0).otherwise(clamp(raw, 0.0, 1.0))


def from_distance(distance: Column, metric: str = "cosine") -> Column:
    """D7 from an engine's distance."""
    raw = {"cosine": 1 - distance, "dot": distance, "ip": distance, "l2": 1 / (1 + distance), "euclid": 1 / (1 + distance)}[metric]
    return F.when(raw.isNull() | F.isnan(raw), 0.0).otherwise(clamp(raw, 0.0, 1.0))
