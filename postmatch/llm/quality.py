"""Quality rules: simple counts and compression bands.

How far clean text compresses depends on its length more than on anything else, so the
limits come from the documents themselves: the quartiles of the ratio over all texts of
a length class that pass the counts, with a margin of some quartile ranges. Up to a
quarter of a class can be junk at either end without moving its limits much. The fewer
texts a class has, the less its quartiles tell, and the wider its margin is.
"""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import map_batches, raw_texts, staged, thin

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Bytes from which a length class starts: two classes for each doubling.
CLASSES = [0, *sorted([64 << k for k in range(15)] + [96 << k for k in range(14)])]
#: A margin of n texts is wider by this many n-ths.
DOUBT = 20
#: Quartile ranges below the lower and above the upper quartile that still pass, and
#: the least quartile range as a share of the quartiles' mean.
MARGINS, LEAST_RANGE = (3.5, 2.5), 0.015
#: Digits of a ratio in quantiles, so that they are exact and few values are counted.
DIGITS = 3


@dataclass(frozen=True)
class Bands:
    """Limits on raw bytes per compressed byte.

    ``whole`` holds (bytes from which it applies, least, most) in falling order: short
    texts compress worse, so their band is wider. Every full chunk of ``chunk_bytes``
    has its own band, and the rest behind them the band of a text of its length; a
    document fails when chunks with more than ``odd_share`` of its bytes, out of at
    least ``least_chunks`` chunks, lie outside. The limits given here are the widest:
    documents tell narrower ones only.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (8192, 1.4, 10.0), (1024, 1.4, 8.0), (256, 0.9, 8.0), (0, 0.0, 1e9))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.4, 10.0)
    least_chunks: int = 2
    odd_share: float = 0.5

    def limits(self, n_bytes: int) -> tuple[float, float]:
        return next((a, b) for size, a, b in self.whole if n_bytes >= size)


def repeated(words: list[bytes]) -> int:
    """Words inside a 5-word window that occurs twice or more."""
    grams = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(grams) == len(set(grams)):
        return 0
    seen, covered, upto = Counter(grams), 0, 0
    for k, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += k + WINDOW - max(k, upto)
            upto = k + WINDOW
    return covered


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def code_points(raw: bytes) -> int:
    return len(raw.decode())


def ratio(raw: bytes, squeeze) -> float:
    return len(raw) / len(squeeze(raw)) if raw else 1.0


def ratios(raw: bytes, bands: Bands, squeeze) -> tuple[float, list[float]]:
    """Ratio of the whole and of its chunks, the last of which may be shorter."""
    size = bands.chunk_bytes
    return ratio(raw, squeeze), [ratio(raw[k:k + size], squeeze) for k in range(0, len(raw), size)]


def verdict(n_bytes: int, whole: float, chunks: list[float], bands: Bands) -> tuple[float, bool]:
    """Share of the bytes that lie in odd chunks, and whether all is in its bands."""
    least, most = bands.limits(n_bytes)
    odd = 0
    for k, value in enumerate(chunks):
        size = min(bands.chunk_bytes, n_bytes - k * bands.chunk_bytes)
        low, high = bands.chunk if size == bands.chunk_bytes else bands.limits(size)
        odd += 0 if low <= value <= high else size
    share = odd / n_bytes if n_bytes else 0.0
    return share, least <= whole <= most and (len(chunks) < bands.least_chunks or share <= bands.odd_share)


def compression(raw: bytes, bands: Bands, squeeze) -> tuple[float, float, bool]:
    """Ratio of the whole, share of odd chunks, and whether both are in their bands."""
    whole, chunks = ratios(raw, bands, squeeze)
    return whole, *verdict(len(raw), whole, chunks, bands)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "base_failed", "ratio", "odd_chunks", "kept")


def counted(raw: bytes) -> tuple:
    """The counts, and whether they make the text fail."""
    words = raw.split()
    again = repeated(words)
    return (len(words), code_points(b"".join(words)), len(raw) - len(raw.translate(None, SYMBOLS)),
            repeated_lines(raw), again, len(words) < 10 or 100 * again > 20 * len(words))


def judged(raw: bytes, bands: Bands, squeeze) -> tuple:
    counts = counted(raw)
    whole, odd, fine = compression(raw, bands, squeeze)
    return *counts, whole, odd, fine and not counts[-1]


COUNTS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, ratio double")
KINDS = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]


def measured(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``doc_id`` with its counts, size, length class and ratios, one row per document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        rows = []
        for raw in raw_texts(batch):
            whole, chunks = ratios(raw, bands, squeeze)
            rows.append((*counted(raw), whole, chunks, len(raw), CLASSES[bisect.bisect(CLASSES, len(raw)) - 1]))
        columns = list(zip(*rows)) if rows else [()] * 10
        kinds = [*KINDS, pa.list_(pa.float64()), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, columns, kinds)],
            ["doc_id", *FIELDS[:7], "chunks", "n_bytes", "size_from"])

    return map_batches(
        thin(docs, "doc_id", "text"), work,
        f"doc_id bigint, {COUNTS}, chunks array<double>, n_bytes bigint, size_from bigint")


def fitted_bands(found: DataFrame, bands: Bands = Bands()) -> Bands:
    """``bands`` made narrower where the measured documents tell how clean text lies.

    Documents that fail by their counts tell nothing. Margins follow the number of the
    others without a step, so that a class of few is judged mildly and one of many by its
    quartiles. Full chunks are a class of their own.
    """
    passed = found.where("NOT base_failed")
    full = passed.select(
        F.lit(-1).cast("bigint").alias("size_from"),
        F.explode(F.expr(f"slice(chunks, 1, int(n_bytes div {bands.chunk_bytes}))")).alias("ratio"))
    quartiles = (
        passed.select("size_from", "ratio").unionAll(full)
        .groupBy("size_from", F.round("ratio", DIGITS).alias("ratio")).agg(F.count("*").alias("n"))
        .groupBy("size_from").agg(F.sum("n").alias("n"), F.percentile("ratio", [0.25, 0.75], F.col("n")).alias("q"))
        .collect())  # one row per length class
    told = {}
    for r in quartiles:
        low, high = r.q
        spread = max(high - low, LEAST_RANGE * (low + high) / 2) * (1 + DOUBT / r.n)
        told[r.size_from] = low - MARGINS[0] * spread, high + MARGINS[1] * spread

    def narrower(key: int, least: float, most: float) -> tuple[float, float]:
        low, high = told.get(key, (least, most))
        return max(least, low), min(most, high)

    starts = sorted({*CLASSES, *(size for size, _, _ in bands.whole)}, reverse=True)
    return replace(
        bands, chunk=narrower(-1, *bands.chunk),
        whole=tuple((s, *narrower(CLASSES[bisect.bisect(CLASSES, s) - 1], *bands.limits(s))) for s in starts))


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``doc_id`` with its counts, compression figures, ``base_failed`` and ``kept``.

    A null text counts as empty: no words, so it fails. A null id is carried along,
    equal rows give equal rows, and an empty table gives an empty one. ``bands`` are
    narrowed by the documents of the table.
    """
    found = staged(measured(docs, bands), "measured")
    bands = fitted_bands(found, bands)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [verdict(*r, bands) for r in zip(
            *(batch.column(c).to_pylist() for c in ("n_bytes", "ratio", "chunks")))]
        failed = batch.column("base_failed").to_pylist()
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", *FIELDS[:7])), pa.array([r[0] for r in rows], pa.float64()),
             pa.array([r[1] and not f for r, f in zip(rows, failed)], pa.bool_())], ["doc_id", *FIELDS])

    return map_batches(found, work, f"doc_id bigint, {COUNTS}, odd_chunks double, kept boolean")


def good_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept."""
    bands = fitted_bands(staged(measured(docs, bands), "measured"), bands)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        return batch.filter(pa.array(
            [judged(raw, bands, squeeze)[-1] for raw in raw_texts(batch)], pa.bool_()))

    return map_batches(docs, work, docs.schema)
