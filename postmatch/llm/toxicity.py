"""Toxicity from two Kneser-Ney models of how words are spelt, one per class.

A word is read letter by letter, each letter given the five before it. The longer
contexts have counts of their own class; the two shortest share the counts of both, so
rare spellings fall back to what the classes have in common. A text is compared by its
two log likelihoods, divided by its length in words: over the whole text, its most toxic
passage of a few words and its most toxic word. A logistic curve, fitted on training
rows that the models have not seen, turns the three into a score.

The models are fitted on a bounded sample of labelled rows: ``per_class`` of each
class, chosen by a hash of the id. Where that bound cuts a class, its rows weigh as many
as they stand for in the curve, so scores follow the classes' shares among all labels.
The counts that the classes share need no weights: those that add up rows have the same
probability in both classes and cancel, and the others count different letters. Rows
held out are never in the sample, and a score uses nothing of a document but its text.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import lower_ascii, map_batches, raw_texts, staged, thin, words

ORDER = 6
SHARED = 2
DISCOUNT = 0.75
#: Least count of a whole letter window; rarer ones are left to the shorter contexts.
LEAST = 2
PER_CLASS = 20_000
PASSAGE = 4
#: Letters from which a word's ratio counts by letter: longer runs are no words.
LONG = 24
THRESHOLD = 0.3
#: Words whose ratio a task remembers.
REMEMBERED = 150_000
FEATURES = ("overall", "passage", "worst")
#: No word speaks more than this against a toxic text; odd spellings are not a virtue.
FLOOR = -1.0
START, END = "\x02", "\x03"


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sampled(labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, tuple[float, float]]:
    """``doc_id, toxic, turn`` of the sample, and the labelled rows of each class that
    one of its rows in the sample stands for."""
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    known = staged(known.withColumn("turn", F.xxhash64(F.col("doc_id"))), "labelled")
    chosen = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy("turn", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    weights = tuple(max(1.0, total.get(kind, 0) / per_class) for kind in (0, 1))
    return staged(chosen, "chosen"), weights  # at most twice per_class rows of three numbers


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    return thin(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", (F.pmod("turn", F.lit(4)) == 0).alias("check"))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``text, toxic, check`` of the sample; every fourth row checks the models."""
    return rows_of(docs, sampled(labels, per_class)[0])


def letter_windows(word: str) -> Iterator[str]:
    """The window that ends at each letter, and at the end of the word."""
    marked = START + word + END
    for k in range(1, len(marked)):
        yield marked[max(0, k - ORDER + 1):k + 1]


def window_counts(rows: DataFrame) -> DataFrame:
    """``part, ordinary, toxic``: how often each letter window occurs in each class."""
    spelt = rows.where("NOT check").select(
        "toxic", F.explode(words(lower_ascii(F.col("text")))).alias("word")
    ).groupBy("toxic", "word").agg(F.count("*").alias("n"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = (Counter(), Counter())
        for kind, word, n in zip(*(batch.column(c).to_pylist() for c in ("toxic", "word", "n"))):
            for part in letter_windows(word):
                counts[kind][part] += n
        parts = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.string()), pa.array([counts[0][p] for p in parts], pa.int64()),
             pa.array([counts[1][p] for p in parts], pa.int64())], ["part", "ordinary", "toxic"])

    return map_batches(spelt, work, "part string, ordinary bigint, toxic bigint").groupBy("part").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def levels(whole: dict[str, int]) -> list[dict[str, int]]:
    """Counts by length: windows as often as they occur, shorter ones by the number of
    different letters before them. A window at a word's start has no letter before it."""
    found: list[Counter] = [Counter() for _ in range(ORDER + 1)]
    for part, n in whole.items():
        found[len(part)][part] += n
    for size in range(ORDER, 1, -1):
        for part in found[size]:
            shorter = part[1:]
            if not shorter.startswith(START):
                found[size - 1][shorter] += 1
    return found


class Ratios:
    """Log ratio of the classes' probabilities: of seen windows, and of falling back."""

    def __init__(self, seen: dict[str, float], fall: dict[str, float]):
        self.seen, self.fall, self.known = seen, fall, {}

    @classmethod
    def fitted(cls, counts: dict[str, tuple[int, int]]) -> Ratios:
        both = levels({p: a + b for p, (a, b) in counts.items()})
        rare = {p for p, (a, b) in counts.items() if len(p) == ORDER and a + b < LEAST}
        (prob, rest), (toxic, left) = (cls._class(counts, k, both, rare) for k in (0, 1))
        seen = {p: math.log(toxic[p] / x) for p, x in prob.items()}
        fall = {h: math.log(left.get(h, 1.0) / rest.get(h, 1.0)) for h in rest.keys() | left.keys()}
        return cls(seen, fall)

    @classmethod
    def _class(cls, counts, kind: int, both, rare: set[str]) -> tuple[dict[str, float], dict[str, float]]:
        """Probability of every window that is not rare, in one class, and the share
        that each context leaves to the shorter one."""
        single = levels({p: n[kind] for p, n in counts.items() if n[kind]})
        letters, total = len(both[1]) + 1, sum(both[1].values()) or 1
        spare = DISCOUNT * len(both[1]) / total
        prob = {p: (n - DISCOUNT) / total + spare / letters for p, n in both[1].items()}
        unknown, rest = max(spare, 1e-9) / letters, {}
        for size in range(2, ORDER + 1):
            own = both[size] if size <= SHARED else single[size]
            totals, kept = Counter(), Counter()
            for p, n in own.items():
                totals[p[:-1]] += n
                if p not in rare:
                    kept[p[:-1]] += n - DISCOUNT
            for h, t in totals.items():
                rest[h] = 1 - kept[h] / t
            for p in both[size]:
                if p in rare:
                    continue
                h, low = p[:-1], cls._lower(prob, rest, p[1:], unknown)
                t = totals.get(h)
                prob[p] = (max(own.get(p, 0) - DISCOUNT, 0) / t + rest[h] * low) if t else low
        return prob, rest

    @staticmethod
    def _lower(prob, rest, part: str, unknown: float) -> float:
        weight = 1.0
        while part:
            if part in prob:
                return weight * prob[part]
            weight *= rest.get(part[:-1], 1.0) if len(part) > 1 else 1.0
            part = part[1:]
        return weight * unknown

    def word(self, raw: bytes) -> float:
        """Log ratio of a word."""
        got = self.known.get(raw)
        if got is None:
            seen, fall, sum_, n = self.seen, self.fall, 0.0, 0
            for part in letter_windows(raw.decode()):
                n += 1
                while part:
                    value = seen.get(part)
                    if value is not None:
                        sum_ += value
                        break
                    if len(part) > 1:
                        sum_ += fall.get(part[:-1], 0.0)
                    part = part[1:]
            got = sum_ * min(1.0, LONG / n)
            if len(raw) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[raw] = got
        return got

    def features(self, raw: bytes) -> tuple[float, ...]:
        """Log ratio by word of the whole text, its most toxic passage and word."""
        found = np.maximum(np.array(list(map(self.word, raw.lower().split()))), FLOOR)
        if not len(found):
            return (0.0,) * len(FEATURES)
        sums = np.concatenate([[0.0], np.cumsum(found)])
        k = min(PASSAGE, len(found))
        return float(found.mean()), float((sums[k:] - sums[:-k]).max() / k), float(found.max())


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, share: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic curve over the features and one, by Newton's method.

    Rows count in proportion to ``share``, all together as often as they are.
    """
    x = np.column_stack([x, np.ones(len(x))])
    share = np.ones(len(x)) if share is None else share / share.mean()
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + ridge * np.eye(len(w)),
                               x.T @ (share * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Shipped:
    """A broadcast model, opened once by each Python worker."""

    opened: dict[str, Ratios] = {}

    def __init__(self, spark, ratios: Ratios):
        packed = [(list(d), np.fromiter(d.values(), np.float32, len(d))) for d in (ratios.seen, ratios.fall)]
        self.sent, self.key = spark.sparkContext.broadcast(packed), uuid.uuid4().hex

    def open(self) -> Ratios:
        if self.key not in Shipped.opened:
            Shipped.opened.clear()
            Shipped.opened[self.key] = Ratios(*(dict(zip(k, v.tolist())) for k, v in self.sent.value))
        return Shipped.opened[self.key]


def with_features(rows: DataFrame, shipped: Shipped, carried: str, kind: str) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ratios = shipped.open()
        found = np.array([ratios.features(raw) for raw in raw_texts(batch)]).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays(
            [batch.column(carried), *map(pa.array, found.T.copy())], [carried, *FEATURES])

    return map_batches(rows, work, f"{carried} {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    A null or empty text has all features zero. A null id is scored and not held out;
    equal rows get equal scores; of several labels of a document the highest counts.
    Without labelled rows of both classes every score is the share of toxic ones, or
    zero without any.
    """
    spark = docs.sparkSession
    chosen, weights_of = sampled(labels, per_class)
    rows = rows_of(docs, chosen)
    found = window_counts(rows).toArrow()
    counts = dict(zip(found["part"].to_pylist(), zip(found["ordinary"].to_pylist(), found["toxic"].to_pylist())))
    del found
    shipped = Shipped(spark, Ratios.fitted(counts))
    del counts
    checked = with_features(rows.where("check").select("text", "toxic"), shipped, "toxic", "int").toPandas()
    y = checked["toxic"].to_numpy(float)
    if len(set(y)) == 2:
        *weights, base = map(float, curve(
            checked[list(FEATURES)].to_numpy(), y, share=np.array(weights_of)[y.astype(int)]))
        mark = sum((F.lit(w) * F.col(f) for w, f in zip(weights, FEATURES)), F.lit(base))
        score = 1 / (1 + F.exp(-mark))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    scored = with_features(thin(docs, "doc_id", "text"), shipped, "doc_id", "bigint")
    return scored.withColumn("score", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)
