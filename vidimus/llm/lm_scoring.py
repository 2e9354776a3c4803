"""Language-model scores by context-tree weighting, beside an add-one word model.

The context-tree model predicts a text byte by byte, each byte as eight binary decisions. Every decision has a
Krichevsky-Trofimov estimate in the context of the 0, 1, ... DEPTH bytes before it, and the estimates of all depths are
mixed by their weights in the context tree of the training corpus. The tree is a table: byte grams are counted over all
texts, dealt by the three bytes before and mixed from the deepest contexts upwards, by partitions from DEPTH to 3 and by
grouped sums from there to 0; on the way back every gram gets its probability. The most frequent words and grams, at most
HEAD of either, are broadcast to the texts, all others are joined by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, scratch, texts_of, word_hashes, written

END = 255  # a byte that UTF-8 never has: the end of a text
#: Bytes of the longest context. A gram is 8 * (DEPTH + 1) bits, the nearest byte before it first and itself last.
DEPTH = 5
#: Bytes before a decision by which the tree is dealt to partitions: so many depths lie above all partitions.
DEALT = 3
#: Words and grams that are broadcast, at most.
HEAD = (1 << 17, 1 << 19)
LN2, LN10 = float(np.log(2)), float(np.log(10))
#: Bytes of texts whose grams are held at once.
PORTION = 4_000_000
#: Keys that a task merges before it sends them, and grams of the tree that it mixes at once (and the rest of one group).
HELD, AT_ONCE = 3_000_000, 200_000

Rows = Iterator[pa.RecordBatch]


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and each end: the gram as one number; and where texts start."""
    raw = np.frombuffer(b"".join(b"\0" * DEPTH + t.lower() + b"\xff" for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(DEPTH * np.arange(1, len(texts) + 1), sizes)
    codes = raw[at]
    for k in range(1, DEPTH + 1):
        codes |= raw[at - k] << (8 * (DEPTH + 1 - k))
    return codes, starts


def _counts(batches: Rows) -> Rows:
    """(kind, key, learned, times): kind 0 words by hash, kind 1 byte grams; learned counts training texts, times all."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], [], []]  # words and grams of held-out texts, then of training texts

    def merged() -> Rows:
        for k, parts in enumerate(held):
            if not parts:
                continue
            keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], np.int64)
            keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
            for at in range(0, len(keys), 50_000):
                some = n[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k % 2, np.int32)), pa.array(keys[at : at + 50_000]), pa.array(some * (k // 2)), pa.array(some)], names=["kind", "key", "learned", "times"])
            parts.clear()

    for batch in batches:
        texts, learned = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in portions(map(len, texts), PORTION):
            for known in (False, True):
                part = [t for t, known_ in zip(texts[i:j], learned[i:j], strict=True) if known_ == known]
                if part:
                    for kind, keys in enumerate((word_hashes([w for t in part for w in t.lower().split()]).view(np.int64), _codes(part)[0])):
                        held[2 * known + kind].append(np.unique(keys, return_counts=True))
            if sum(len(k) for parts in held for k, _ in parts) > HELD:
                yield from merged()
    yield from merged()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0, by Stirling's series after a shift."""
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift * y, shift)
        y = np.where(low, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def krichevsky_trofimov(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the estimate of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Nodes:
    """Decisions of one depth: sorted numbers (context, bits so far), how often each went to 0 and to 1, and their weights."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, trust: np.ndarray) -> None:
        """weighted: the logarithm of the mixed estimate; trust: how far a decision trusts itself against the longer contexts."""
        self.ids, self.zeros, self.ones, self.weighted, self.trust = ids, zeros, ones, weighted, trust

    @classmethod
    def leaves(cls, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> Nodes:
        return cls(ids, zeros, ones, krichevsky_trofimov(zeros, ones), np.ones(len(ids)))

    @classmethod
    def inner(cls, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Nodes:
        """below: the sum of the weighted logarithms of the contexts that are one byte longer."""
        own = krichevsky_trofimov(zeros, ones)
        weighted = np.logaddexp(own, below) - LN2
        return cls(ids, zeros, ones, weighted, np.exp(own - LN2 - weighted))

    def above(self) -> Nodes:
        """The decisions with contexts one byte shorter."""
        ids, group = np.unique(self.ids >> 16 << 8 | self.ids & 255, return_inverse=True)
        return Nodes.inner(ids, *(np.bincount(group, x, len(ids)) for x in (self.zeros, self.ones, self.weighted)))

    def mixed(self, wanted: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """P(1) for wanted decisions, given the longer contexts' (NaN where they never met the decision), NaN where this one never was met."""
        if not len(self.ids):
            return np.full(len(wanted), np.nan)
        at = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
        zeros, ones, trust = self.zeros[at], self.ones[at], self.trust[at]
        own = (ones + 0.5) / (zeros + ones + 1)
        out = np.where(np.isnan(deeper), own, trust * own + (1 - trust) * deeper)
        return np.where(self.ids[at] == wanted, out, np.nan)


def decisions(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each gram and each of its 8 bits, most significant first: the number of the decision at that depth, and the bit."""
    byte = codes & 255
    context = codes >> (8 * (DEPTH + 1 - depth)) << 8
    bits = np.arange(8)
    return context[:, None] | (1 << bits) | byte[:, None] >> (8 - bits), byte[:, None] >> (7 - bits) & 1


def subtrees(codes: np.ndarray, learned: np.ndarray) -> list[Nodes]:
    """From depth DEPTH to DEALT, for all grams of some groups of DEALT bytes before."""
    seen = learned > 0
    ids, bits = decisions(codes[seen], DEPTH)
    each, group = np.unique(ids.ravel(), return_inverse=True)
    times, bits = np.repeat(learned[seen], 8), bits.ravel()
    levels = [Nodes.leaves(each, np.bincount(group, times * (1 - bits), len(each)), np.bincount(group, times * bits, len(each)))]
    while len(levels) <= DEPTH - DEALT:
        levels.append(levels[-1].above())
    return levels


def _groups(batches: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, times learned) of a partition sorted by gram, cut between groups of DEALT bytes before. A group has at most 256 ** (DEPTH + 1 - DEALT) grams."""
    shift = 8 * (DEPTH + 1 - DEALT)
    codes, learned = np.array([], np.int64), np.array([], np.int64)
    for batch in batches:
        codes, learned = np.concatenate([codes, batch.column(0).to_numpy()]), np.concatenate([learned, batch.column(1).to_numpy()])
        if len(codes) >= AT_ONCE:
            cut = int(np.searchsorted(codes, codes[-1] >> shift << shift))
            if cut:
                yield codes[:cut], learned[:cut]
                codes, learned = codes[cut:], learned[cut:]
    if len(codes):
        yield codes, learned


def _rows(nodes: Nodes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes.ids, nodes.zeros, nodes.ones, nodes.weighted, nodes.trust)], names=["id", "zeros", "ones", "weighted", "trust"])


NODE = "id long, zeros double, ones double, weighted double, trust double"


def _dealt(batches: Rows) -> Rows:
    for codes, learned in _groups(batches):
        yield _rows(subtrees(codes, learned)[-1])


def _weighed(batches: Rows) -> Rows:
    """Grouped sums over the children become decisions."""
    for batch in batches:
        yield _rows(Nodes.inner(*(batch.column(k).to_numpy() for k in range(4))))


def upper_levels(dealt: DataFrame) -> list[Nodes]:
    """Depths DEALT - 1 to 0, by grouped sums; numbers have at most 8 * DEALT bits, a few hundred thousand in practice."""
    out, level = [], dealt
    for _ in range(DEALT):
        parent = F.shiftleft(F.shiftright("id", 16), 8).bitwiseOR(F.col("id").bitwiseAND(255))
        level = written(level.groupBy(parent.alias("id")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")).mapInArrow(_weighed, NODE))
        rows = level.orderBy("id").toPandas()
        out.append(Nodes(rows["id"].to_numpy(np.int64), *(rows[c].to_numpy(np.float64) for c in ("zeros", "ones", "weighted", "trust"))))
    return out


def log_probability(codes: np.ndarray, levels: list[Nodes]) -> np.ndarray:
    """ln P(byte | the bytes before) of each gram; levels from DEPTH to 0. A decision that was never met anywhere is even."""
    one = np.full(8 * len(codes), np.nan)
    for depth, nodes in zip(range(DEPTH, -1, -1), levels, strict=True):
        one = nodes.mixed(decisions(codes, depth)[0].ravel(), one)
    one = np.where(np.isnan(one), 0.5, one)
    return np.log(np.where(decisions(codes, 0)[1].ravel() == 1, one, 1 - one)).reshape(-1, 8).sum(axis=1)


def gram_logs(grams: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of each gram, by the context tree of those learned. grams: key, learned, sorted in partitions by the bytes before."""
    upper = upper_levels(written(grams.mapInArrow(_dealt, NODE)))
    sent = grams.sparkSession.sparkContext.broadcast([(n.ids, n.zeros, n.ones, n.weighted, n.trust) for n in upper])

    def run(batches: Rows) -> Rows:
        above = [Nodes(*n) for n in sent.value]
        for codes, learned in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(log_probability(codes, [*subtrees(codes, learned), *above]) / LN10)], names=["key", "value"])

    return grams.mapInArrow(run, "key long, value double")


def _left(texts: np.ndarray, keys: np.ndarray, n_texts: int) -> tuple[pa.Array, pa.Array]:
    """By text, its distinct keys and their numbers."""
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.array([], np.int64)
    ends = pa.array(np.searchsorted(texts[first], np.arange(n_texts + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(keys[first])), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(first, len(keys))).astype(np.int32)))


def _scored(head) -> Callable[[Rows], Rows]:  # noqa: ANN001
    def run(batches: Rows) -> Rows:
        """One row a text; words and grams beyond the head are left to the join, as distinct keys with their numbers."""
        row = TaskContext.get().partitionId() << 40

        def met(kind: int, keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
            """By text: how many keys the head knows, the sum of their values, and the keys that it doesn't know."""
            known_keys, values = head.value[kind]
            at = np.minimum(np.searchsorted(known_keys, keys), max(len(known_keys) - 1, 0))
            known = known_keys[at] == keys if len(known_keys) else np.zeros(len(keys), bool)
            sums = np.bincount(owner[known], values[at[known]] if len(known_keys) else None, n)
            return np.bincount(owner[known], minlength=n), sums.astype(np.float64), *_left(owner[~known], keys[~known], n)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in portions(map(len, texts), PORTION):
                part, n = texts[i:j], j - i
                split = [t.lower().split() for t in part]
                words = met(0, word_hashes([w for ws in split for w in ws]).view(np.int64), np.repeat(np.arange(n), [len(ws) for ws in split]), n)
                codes, starts = _codes(part)
                grams = met(1, codes, np.repeat(np.arange(n), np.diff(np.append(starts, len(codes)))), n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(i, n), pa.array([len(ws) for ws in split], pa.int64()), pa.array([len(t) for t in part], pa.int64()),
                    pa.array(words[0].astype(np.int64)), pa.array(words[1]), pa.array(grams[1]), *words[2:], *grams[2:],
                ], names=["row_", "doc_id", "words", "bytes", "head_known", "head_gain", "head_model", "keys", "numbers", "grams", "times"])
                row += n

    return run


def most_frequent(known: DataFrame, most: tuple[int, ...]) -> Column:
    """A condition that at most so many rows of each kind satisfy: times within the upper steps of a logarithmic histogram."""
    step = F.floor(F.log2("times") * 8)
    held, least = {}, {}
    for kind, at, n in sorted((tuple(r) for r in known.groupBy("kind", step.alias("step")).count().collect()), reverse=True):
        held[kind] = held.get(kind, 0) + n
        if held[kind] <= most[kind]:
            least[kind] = at
    out = F.lit(False)
    for kind, at in least.items():
        out |= (F.col("kind") == kind) & (step >= at)
    return out


def lm_scores(documents: DataFrame, held_out: Callable[[str], Column]) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per row of documents.

    Learned from the rows that held_out (a condition on doc_id) doesn't choose. Null and empty texts have one token, their end,
    which is known as soon as there is a training row. base_score is the add-one word model's log10 probability, score the
    context tree's; bits_per_byte counts the end as a byte. A decision that the training texts never met in a context is left
    to the longest context in which they did. Repeated rows and null ids are scored and counted like others. Only doc_id and
    text are read. An empty table gives an empty result; without training rows all bits weigh one half.
    """
    spark = documents.sparkSession
    texts = texts_of(documents)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = "row_ long, doc_id long, words long, bytes long, head_known long, head_gain double, head_model double, keys array<long>, numbers array<int>, grams array<long>, times array<int>"
    with scratch(spark) as keep:
        counted = texts.select("text", (~held_out("doc_id")).alias("learned")).mapInArrow(_counts, "kind int, key long, learned long, times long")
        counted = written(counted.groupBy("kind", "key").agg(F.sum("learned").alias("learned"), F.sum("times").alias("times")))
        ends = texts.where(~held_out("doc_id")).count()
        sums = {r.kind: r for r in counted.groupBy("kind").agg(F.sum("learned").alias("learned"), F.sum("times").alias("times"), F.count_if(F.col("learned") > 0).alias("distinct")).collect()}
        tokens, distinct = (sums[0].learned if 0 in sums else 0) + ends, (sums[0].distinct if 0 in sums else 0) + (ends > 0)
        group = F.shiftright("key", 8 * (DEPTH + 1 - DEALT))
        grams = counted.where("kind = 1").select("key", "learned").repartition(parts, group).sortWithinPartitions("key")
        words = counted.where("kind = 0 and learned > 0").select("kind", "key", "times", F.log10(F.col("learned") + 1.0).alias("value"))
        logs = written(gram_logs(grams))
        known = words.union(counted.where("kind = 1").join(logs, "key").select("kind", "key", "times", "value"))
        known = keep(written(known))
        often = most_frequent(known, HEAD)
        chosen = []
        for kind in (0, 1):
            some = known.where(often & (F.col("kind") == kind)).select("key", "value").toArrow().sort_by("key")
            chosen.append((some["key"].to_numpy(), some["value"].to_numpy()))
        scored = keep(written(texts.mapInArrow(_scored(spark.sparkContext.broadcast(chosen)), schema)))
    rest = [scored.select("row_", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(n).alias("n"))).alias("w")) for kind, keys, n in ((0, "keys", "numbers"), (1, "grams", "times"))]
    rest = rest[0].union(rest[1]).select("row_", "kind", "w.key", "w.n").join(known.where(~often).select("kind", "key", "value"), ["kind", "key"])
    word, gain = F.col("kind") == 0, F.col("n") * F.col("value")
    rest = rest.groupBy("row_").agg(F.sum(F.when(word, F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(word, gain).otherwise(0.0)).alias("gain"), F.sum(F.when(word, 0.0).otherwise(gain)).alias("model"))
    each = float(np.log10(tokens + distinct + 1))
    end_gain = float(np.log10(ends + 1))
    out = scored.drop("keys", "numbers", "grams", "times").join(rest, "row_", "left")
    n_tokens, score = F.col("words") + 1, F.col("head_model") + F.coalesce("model", F.lit(0.0))
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), n_tokens.alias("n_tokens"),
        (F.col("head_known") + F.coalesce("known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_gain") + F.coalesce("gain", F.lit(0.0)) + end_gain - n_tokens * each).alias("base_score"), score.alias("score"),
        (-score * F.lit(float(np.log2(10))) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
