"""Find the terms of a large vocabulary in texts.

A literal list is looked up term by term, which costs vocabulary times text. Here every
term is keyed by one of its grams, stretches of GRAM characters (twice as many in a term that
long), one that few terms share. A text's distinct grams are joined to those keys, and only the
terms whose key occurs are looked for in the text. Texts stay in their scan tasks: the keys travel,
in blocks of bounded size, and a text's grams, join and check are one pipeline, so no
text is exchanged or copied per gram. Which grams of a text may be keys is told by two bits for
each key, over Arrow batches of texts, so that only those become rows. Where the keys
need several blocks, those that occur in no text are left out first, which takes one pass over
the texts in place of one a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.text import contained_terms, tokens
from postmatch.operators.pairing import MAX_BYTES, table_size

GRAM = 5
#: Terms shorter than a gram that are looked up one by one, at most.
FEW_SHORT = 16
#: Counters of the terms that share a gram, and bits that tell which grams may be keys, at most.
COUNTERS = 1 << 20
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bytes of texts that are hashed at once, about; a text is never split.
MOST_TEXT = 1 << 20
#: Bits and bytes of a row of Spark's bitmap functions.
BITMAP_BYTES = 4096


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The characters of some texts after another as code points, and where each text begins
    and the last one ends."""
    each = [t.decode("utf-8", "replace") if t else "" for t in texts.cast(pa.binary()).to_pylist()]
    lengths = np.fromiter(map(len, each), np.int64, len(each))
    ends, at = np.cumsum(lengths), 0
    while at < len(each):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + MOST_TEXT, "right")))
        points = np.frombuffer("".join(each[at:stop]).encode("utf-32-le"), np.uint32)
        yield points, np.concatenate([[0], ends[at:stop] - before])
        at = stop


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of the stretch of ``size`` characters that begins at each place."""
    places = max(0, len(points) - size + 1)
    out = np.full(places, 2166136261 ^ size, np.uint32)
    for at in range(size):
        out ^= points[at:at + places]
        out *= np.uint32(16777619)
    out ^= out >> np.uint32(15)
    out *= np.uint32(2246822507)
    out ^= out >> np.uint32(13)
    return out


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one range after another."""
    return np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _strings(points: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of characters."""
    taken = points[_ranges(begins, sizes)]
    ends = np.concatenate([[0], np.cumsum(1 + (taken >= 0x80) + (taken >= 0x800) + (taken >= 0x10000))])
    places = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    data = taken.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(places), pa.py_buffer(data))


def _own_grams(points: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of gram: the terms that have grams of that length, how many each, and the hashes of all."""
    lengths = np.diff(starts)
    for n, rows in ((size, (lengths >= size) & (lengths < 2 * size)), (2 * size, lengths >= 2 * size)):
        rows = np.flatnonzero(rows)
        if len(rows):
            many = lengths[rows] - n + 1
            yield n, rows, many, _hashes(points, n)[_ranges(starts[rows], many)] & np.uint32(COUNTERS - 1)


def _gram_counts(terms: DataFrame, size: int) -> np.ndarray:
    """How many grams of all terms fall to each counter."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for points, starts in _slices(batch.column(0)):
                for _, _, _, hashes in _own_grams(points, starts, size):
                    total += np.bincount(hashes, minlength=COUNTERS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["slot", "n"])

    table = terms.mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[table["slot"].to_numpy()] = np.minimum(table["n"].to_numpy(), np.iinfo(np.int32).max)
    return counts


def _bits(hashes: np.ndarray, mask: np.uint32, turn: int) -> np.ndarray:
    """The first or second bit of each hash."""
    return (hashes * np.uint32(3266489917) >> np.uint32(4) if turn else hashes) & mask


def keyed(terms: DataFrame, size: int = GRAM, stage=None) -> DataFrame:
    """``term, gram``: every distinct term with a gram that the fewest terms have.

    Grams are counted by hash, so others may count as its sharers: any gram is a right key. A term
    of less than twice ``size`` has grams of ``size``, a longer one of twice that, and one shorter
    than ``size`` is its own key. Null and empty terms are left out. ``stage`` keeps the terms
    from being made twice.
    """
    distinct = terms.select("term").where("term != ''").distinct()
    distinct = stage(distinct) if stage is not None else distinct
    counts = _gram_counts(distinct, size)

    @F.arrow_udf("string")
    def rarest(terms: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for points, starts in _slices(terms):
            begins, sizes = starts[:-1].copy(), np.diff(starts)
            for n, rows, many, hashes in _own_grams(points, starts, size):
                firsts = np.cumsum(many) - many
                order = np.arange(len(hashes)) - np.repeat(firsts, many)
                begins[rows] += np.minimum.reduceat((counts[hashes].astype(np.int64) << 32) + order, firsts) & 0xFFFFFFFF
                sizes[rows] = n
            parts.append(_strings(points, begins, sizes))
        return pa.concat_arrays(parts)

    return distinct.select("term", rarest("term").alias("gram"))


def _key_marks(keys: DataFrame, rows: int) -> np.ndarray:
    """The bits of all keys' grams set, of thirty-two for each key if that is not too many."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * rows).bit_length()))

    @F.arrow_udf("array<long>")
    def places(grams: pa.Array) -> pa.Array:
        parts = [np.zeros((0, 2), np.int64)]
        for points, starts in _slices(grams):
            sizes = np.diff(starts)
            out = np.zeros((len(sizes), 2), np.int64)
            for n in np.unique(sizes).tolist():
                own = sizes == n
                hashes = _hashes(points, n)[starts[:-1][own]]
                for turn in range(2):
                    out[own, turn] = _bits(hashes, np.uint32(bits - 1), turn)
            parts.append(out)
        # Spark counts bits from 1.
        flat = np.concatenate(parts).ravel() + 1
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat))

    at = keys.select("gram").distinct().select(F.explode(places("gram")).alias("at"))
    marks = np.zeros(bits // 8, np.uint8)
    for row in at.groupBy(F.bitmap_bucket_number("at").alias("number")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        begin = (row["number"] - 1) * BITMAP_BYTES
        marks[begin:begin + BITMAP_BYTES] = np.frombuffer(row["bits"], np.uint8)
    return marks


def _maybe_keys(sizes: Sequence[int], marks: np.ndarray) -> Callable[[Column], Column]:
    """The distinct stretches of a text of these lengths whose bits are all set."""
    sizes, mask = list(sizes), np.uint32(len(marks) * 8 - 1)

    def listed(points: np.ndarray, starts: np.ndarray) -> pa.Array:
        places, widths = [], []
        for n in sizes:
            hashes = _hashes(points, n)
            at = np.arange(len(hashes))
            for turn in range(2):
                bit = _bits(hashes[at], mask, turn)
                at = at[np.flatnonzero(marks[bit >> np.uint32(3)] >> (bit & np.uint32(7)).astype(np.uint8) & 1)]
            # A stretch may not run into the next text.
            places.append(at[at + n <= starts[np.searchsorted(starts, at, "right")]])
            widths.append(np.full(len(places[-1]), n))
        at, width = np.concatenate(places), np.concatenate(widths)
        coded = _strings(points, at, width).dictionary_encode()
        row = np.searchsorted(starts, at, "right") - 1
        many = max(1, len(coded.dictionary))
        once = np.unique(row * many + coded.indices.to_numpy(zero_copy_only=False))
        ends = np.searchsorted(once, np.arange(len(starts)) * many).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(once % many)))

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(listed(*one) for one in _slices(texts))])

    return found


def terms_in(texts: DataFrame, terms: DataFrame, *, size: int = GRAM, max_bytes: int = MAX_BYTES,
             stage=None) -> DataFrame:
    """``id, term`` for every term that is a substring of a text.

    ``texts`` has ``id, text`` and ``terms`` has ``term``; both are compared as they are.
    A null text has no term. A vocabulary of more than ``max_bytes`` passes over the
    texts block after block. ``stage``, a function that writes a table and reads it again,
    keeps the keys from being chosen once per block, and those in no text from needing blocks.
    """
    keys = keyed(terms, size, stage)
    keys = stage(keys) if stage is not None else keys
    tiny = F.char_length("gram") < size
    short = [r[0] for r in keys.where(tiny).select("term").limit(FEW_SHORT + 1).collect()]
    sizes = [size, 2 * size]
    if len(short) > FEW_SHORT:
        sizes = sorted({*sizes, *(r[0] for r in keys.select(F.char_length("gram")).distinct().collect())})

    def cut(rows: int) -> DataFrame:
        """Each text with its stretches that may be keys."""
        own = _maybe_keys(sizes, _key_marks(keys, rows))(F.col("text"))
        if 0 < len(short) <= FEW_SHORT:
            # Stretches of each short length would cost as much as those of the whole vocabulary.
            own = F.concat(own, contained_terms(F.col("text"), sorted(short)))
        return texts.select("id", "text", F.explode(own).alias("gram"))

    rows, width = table_size(keys)
    blocks = ceil(width / max_bytes)
    each = cut(rows)
    if blocks > 1 and stage is not None:
        keys = stage(keys.join(each.select("gram").distinct(), "gram", "left_semi").select("term", "gram"))
        rows, width = table_size(keys)
        blocks = ceil(width / max_bytes)
        each = cut(rows)
    own = F.pmod(F.xxhash64("gram"), F.lit(max(blocks, 1)))

    def found(block: int) -> DataFrame:
        part = keys if blocks <= 1 else keys.where(own == block)
        return each.join(F.broadcast(part), "gram").where(F.contains("text", "term")).select("id", "term")

    return reduce(DataFrame.unionAll, [found(block) for block in range(max(blocks, 1))])


def as_tokens(text: Column) -> Column:
    """Normalised text as its tokens, each between spaces, or nothing.

    A term so written occurs in a text so written where its tokens follow each other,
    and never inside a longer token.
    """
    found = tokens(text)
    return F.when(F.size(found) > 0, F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" ")))


def tokens_in(texts: DataFrame, terms: DataFrame, **more) -> DataFrame:
    """As :func:`terms_in`, where a term has to match whole tokens of normalised text."""
    sought = terms.select("term", as_tokens(F.col("term")).alias("sought")).where("sought IS NOT NULL").distinct()
    if more.get("stage") is not None:
        sought = more["stage"](sought)
    found = terms_in(
        texts.select("id", as_tokens(F.col("text")).alias("text")), sought.select(F.col("sought").alias("term")), **more)
    # Terms that differ only between their tokens share what is sought.
    return found.withColumnRenamed("term", "sought").join(sought, "sought").select("id", "term")
