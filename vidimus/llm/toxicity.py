"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, lexicon hits near a second-person word, capitals, punctuation and
obfuscation. The learned lexicon holds words and word beginnings that toxic training rows have far more often than others.
Labelled rows are dealt by digest into three parts, for the lexicon, the trees and the calibration.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, texts_of, written

#: Labelled rows that are learned from, at most (the bound of the sample; drawn by digest).
SAMPLE = 60_000
#: Terms of the learned lexicon, at most.
TERMS = 2_000
#: A learned term: in so many toxic rows at least (and one more for each tenfold of rows), and so much likelier there (natural logarithm).
LEAST_ROWS, LEAST_GAIN = 1.5, 3.0
#: A beginning of words says nothing new if one word makes up this share of its toxic rows.
ONE_WORD = 0.75
NEAR = 5  # words

# Insults, and second-person words of four languages.
INSULTS = frozenset(
    (
        "idiot idiots idiotic moron morons stupid stupidity loser losers pathetic worthless scum trash clown clowns disgusting dumb dumbass fool fools jerk creep"
        " garbage freak imbecile coward cowards liar ugly hate filthy vermin pig bastard bitch shit crap asshole damn suck sucks"
        " trottel depp arschloch dumm wertlos abschaum idioten imbécile crétin connard minable ordure déchet débile"
        " estúpido imbécil basura patético inútil asqueroso idiota tonto"
    ).encode().split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr tu te toi ton ta tes vous votre tú usted ustedes tus vosotros".encode().split())

_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_MASKS = str.maketrans("013457@$!*", "oieastasi*")
FEATURES = ("fixed", "fixed_density", "learned", "learned_density", "learned_most", "near_second", "capitals", "shouted", "marks", "exclaimed", "masked", "masked_density", "length")


def features(text: bytes, learned: dict[bytes, float]) -> list[float]:
    """The dense features of one text; all are 0 for an empty one."""
    words = text.translate(_CLEAN).split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    gains: dict[bytes, float] = {}
    for w in set(words):
        if g := max(learned.get(w, 0.0), learned.get(w[:4] + b"*", 0.0), learned.get(w[:5] + b"*", 0.0)):
            gains[w] = g
    strong = [i for i, w in enumerate(words) if w in gains] if gains else []
    hits = sorted({*fixed, *strong})
    near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    letters = sum(map(text.count, _LETTERS))
    raw = np.frombuffer(text, np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    marks = int(((raw > 32) & (raw < 128)).sum()) - letters
    tokens = text.split()
    shouted = sum(len(t) > 2 and t.isupper() for t in tokens)
    # Marks at a word's ends are punctuation; within a word they may hide it.
    odd = [s for t in tokens if not t.isalpha() and not (s := t.strip(b".,!?;:")).isalpha() and any(c in s for c in _HIDING)]
    masked = 0
    for t in odd:
        s = t.lower()
        plain = s.decode("utf-8", "ignore").translate(_MASKS).replace(".", "").replace("-", "").encode()
        masked += plain != s and plain in INSULTS
    return [
        math.log1p(len(fixed)), len(fixed) / n, math.log1p(len(strong)), len(strong) / n, max(gains.values(), default=0.0), math.log1p(near),
        upper / max(1, upper + lower), shouted / len(tokens), marks / max(1, len(text)), text.count(b"!") / n, math.log1p(masked), len(odd) / len(tokens), math.log1p(n),
    ]


_HIDING = (b"@", b"$", b"*", b"0", b"1", b"3", b".")
_LETTERS = [bytes([c]) for c in range(128) if chr(c).isalnum()]


def featured(texts: DataFrame, learned: dict[bytes, float]) -> DataFrame:
    """row, and one double a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for i, j in portions(map(len, values)):
                rows = np.array([features(t, learned) for t in values[i:j]], np.float64).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def crc(c: str) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))


def learn_lexicon(texts: DataFrame) -> dict[bytes, float]:
    """Terms of toxic rows with their gain: words, and beginnings of 4 or 5 letters marked by *. texts: text bytes, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(text.translate(_CLEAN).split())
                for term in {*words, *(w[:4] + b"*" for w in words if len(w) > 3), *(w[:5] + b"*" for w in words if len(w) > 4)}:
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), *(pa.array((v[k] for v in counts.values()), pa.int64()) for k in (0, 1))], names=["term", "clean", "toxic"])

    clean, toxic = texts.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    gain = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counted = texts.select("text", "toxic").mapInArrow(run, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = int(LEAST_ROWS + math.log10(max(clean + toxic, 1)))
    kept = counted.withColumn("gain", gain).where((F.col("toxic") >= least) & (F.col("gain") >= LEAST_GAIN))
    rows = kept.orderBy(F.desc(F.col("toxic") * F.col("gain")), "term").limit(TERMS).collect()
    most: dict[bytes, int] = {}  # by beginning: toxic rows of its commonest word
    for r in rows:
        word = bytes(r.term)
        if not word.endswith(b"*"):
            for n in (4, 5):
                most[word[:n] + b"*"] = max(most.get(word[:n] + b"*", 0), r.toxic)
    return {bytes(r.term): r.gain for r in rows if most.get(bytes(r.term), 0) < ONE_WORD * r.toxic}


def train(documents: DataFrame, labels: DataFrame, trainable: Callable[[str], Column], sample: int = SAMPLE) -> tuple[dict[bytes, float], PipelineModel | None, object]:
    """The learned lexicon, the trees, and the calibration; no trees where the sample lacks one of the classes."""
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(trainable("doc_id"))
    chosen = F.broadcast(written(chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample).withColumnRenamed("doc_id", "of")))
    part = F.conv(F.substring(F.md5(F.concat(F.lit("part"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("long") % 10
    rows = texts_of(documents).join(chosen, F.col("doc_id") == F.col("of"))
    rows = written(rows.select("doc_id", "text", "toxic", part.alias("part")))
    learned = learn_lexicon(rows.where("part < 5"))
    # A learned row's own text doesn't tell how its terms do elsewhere, so trees and calibration have rows of their own.
    told = rows.select("doc_id", "toxic", "part").distinct()
    known = written(featured(rows.where("part >= 5").select("doc_id", "text"), learned).distinct().join(F.broadcast(told), "doc_id"))
    fit, rest = known.where("part < 8"), known.where("part >= 8")
    if fit.select("toxic").distinct().count() < 2 or rest.select("toxic").distinct().count() < 2:
        return learned, None, None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="dense")
    trees = GBTClassifier(featuresCol="dense", labelCol="toxic", maxIter=20, maxDepth=4, stepSize=0.3, seed=7, maxBins=64, minInstancesPerNode=4).fit(assembler.transform(fit))
    model = PipelineModel([assembler, trees])
    rated = model.transform(rest).select(vector_to_array("probability")[1].alias("raw"), F.col("toxic").cast("double").alias("toxic"))
    return learned, model, IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(rated)


def toxicity(documents: DataFrame, labels: DataFrame, trainable: Callable[[str], Column], sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted), one row per row of documents.

    Rows whose id satisfies trainable are learned from, where labels has them; at most sample of them. A null or empty text is
    scored by its features, which are all 0. A null id is scored too. Repeated rows are each answered alike. Without usable
    labels (an empty table, one class) the score is 1 less exp of minus the fixed lexicon's hits. Only doc_id and text are read.
    """
    return rated(documents, *train(documents, labels, trainable, sample))


def rated(documents: DataFrame, learned: dict[bytes, float], model: PipelineModel | None, calibration: object) -> DataFrame:
    """toxicity() by what train() has learned."""
    dense = featured(texts_of(documents), learned)
    if model is None:
        scored = dense.select("doc_id", (1 - F.exp(1 - F.exp("fixed"))).alias("score"))
    else:
        raw = model.transform(dense).select("doc_id", vector_to_array("probability")[1].alias("raw"))
        # Steps of the calibration are flat; a grain of the raw score keeps their order.
        scored = calibration.transform(raw).select("doc_id", (0.999 * F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)) + 0.001 * F.col("raw")).alias("score"))
    return scored.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
