"""Passages that repeat across documents, by Rabin-Karp hashes of every window.

Every window of 50 words has a polynomial hash of 64 bits, rolled over the text. The
windows are dealt into buckets by the least hash of their 8-word parts: equal windows
have equal parts, and neighbours mostly share the least one, so a bucket gets runs of
windows and answers in runs. A task packs what it read in slabs: of windows that a slab
holds more than once only those of the smallest document travel, the rest are known to
be repeats. So a passage that most documents share costs one entry per slab.

A part that many different windows share, such as a common line, would make its bucket
large. So what all slabs would send is counted first, by bucket, and a bucket of more
than GROUP windows is split by the windows' own hashes: equal ones still meet. What
cannot be split is one window's entries, one per slab that holds it.

In a group, windows with equal hashes meet; those outside the smallest document are
repeats. Runs of them are the removal intervals, joined to the texts by document.

Two different windows count as equal when 56 bits of hash and the bucket agree: among n
windows about n**2 / 2**(57 + log2(buckets)) pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import map_batches, raw_texts, thin

WINDOW = 50
PART = 8
#: Words that a slab packs at once; a longer document is a slab of its own.
SLAB = 1 << 19
#: Word hashes remembered by a task.
REMEMBERED = 1 << 19
#: Buckets for each shuffle partition.
SPREAD = 4
#: Windows that a group holds, about; larger buckets are split into several.
GROUP = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.ones(n, np.uint64)
            steps[1:] = BASE
            cls.up = np.cumprod(steps)
            steps[1:] = pow(BASE, -1, 1 << 64)
            cls.down = np.cumprod(steps)
        return cls.up[:n], cls.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of word hashes, and the least hash of its parts."""
    n = len(words)
    up, down = Powers.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    whole = mixed((sums[WINDOW:] - sums[:-WINDOW]) * down[:n - WINDOW + 1])
    least = mixed((sums[PART:] - sums[:-PART]) * down[:n - PART + 1])
    width, goal = 1, WINDOW - PART + 1
    while 2 * width <= goal:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = goal - width
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    return whole, least


def runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive positions of one document, as (doc, start, length)."""
    if not len(doc):
        return doc, at, at
    first = np.flatnonzero(np.concatenate(
        [[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
    return doc[first], at[first], np.diff(np.append(first, len(doc)))


def packed(doc: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> bytes:
    d, start, size = runs(doc, at)
    short = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :7])
    return b"".join((np.int64(len(d)).tobytes(), d.astype(np.int64).tobytes(),
                     start.astype(np.int32).tobytes(), size.astype(np.int32).tobytes(), short.tobytes()))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    d = np.frombuffer(blob, np.int64, n, 8)
    start = np.frombuffer(blob, np.int32, n, 8 + 8 * n).astype(np.int64)
    size = np.frombuffer(blob, np.int32, n, 8 + 12 * n)
    short = np.frombuffer(blob, np.uint8, offset=8 + 16 * n).reshape(-1, 7)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :7] = short
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(len(short)) - np.repeat(first, size) + np.repeat(start, size)
    return np.repeat(d, size), at, wide.view(np.uint64).ravel()


class Slab(NamedTuple):
    """The windows that a slab sends, and the runs of repeats that it sees itself."""

    doc: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    least: np.ndarray
    known: tuple[np.ndarray, np.ndarray, np.ndarray]


def _slab(docs: list[tuple[int, np.ndarray]]) -> Slab | None:
    docs.sort(key=lambda x: x[0])
    sizes = np.array([len(w) for _, w in docs])
    words = np.concatenate([w for _, w in docs])
    row = np.repeat(np.arange(len(docs)), sizes)
    ids = np.array([d for d, _ in docs], np.int64)
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, least = window_hashes(words)
    own = row[:len(hashes)] == row[WINDOW - 1:]
    hashes, least = hashes[own], least[own]
    doc, at = ids[row[:len(own)][own]], at[:len(own)][own]
    if not len(hashes):
        return None
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
    smallest = np.empty_like(doc)
    smallest[order] = np.repeat(doc[order][starts], np.diff(np.append(starts, len(order))))
    again = doc > smallest
    known = runs(doc[again], at[again])
    return Slab(doc[~again], at[~again], hashes[~again], least[~again], known)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[Slab]:
    """Slabs of whole documents, as they are read."""
    remembered, held, size = WordHashes(), [], 0
    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
            words = raw.split()
            if doc is None or len(words) < WINDOW:
                continue
            if held and size + len(words) > SLAB:
                yield _slab(held)
                held, size = [], 0
            held.append((doc, np.fromiter(map(remembered.__getitem__, words), np.uint64, len(words))))
            size += len(words)
    if held:
        yield _slab(held)


def splits(docs: DataFrame, buckets: int) -> np.ndarray:
    """Into how many groups each bucket goes, by the windows that all slabs would send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for slab in filter(None, _slabs(batches)):
            total += np.bincount((slab.least % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = thin(docs, "doc_id", "text").mapInArrow(run, "bucket bigint, n bigint")
    groups = np.ones(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        groups[row.bucket] = -(-row.n // GROUP)
    return groups


def windows(docs: DataFrame, groups: np.ndarray) -> DataFrame:
    """``bucket, blob`` of packed windows, numbered through all groups of all buckets, or
    ``doc_id, start, size`` of known repeats."""
    buckets = len(groups)
    first = np.cumsum(groups) - groups

    def rows(slab: Slab) -> Iterator[tuple]:
        for d, start, size in zip(*slab.known):
            yield int(d) % buckets, None, int(d), int(start), int(size)
        bucket = (slab.least % np.uint64(buckets)).astype(np.int64)
        # The upper half of a hash chooses the group.
        piece = ((slab.hashes >> np.uint64(32)) * groups[bucket].astype(np.uint64)) >> np.uint64(32)
        bucket = first[bucket] + piece.astype(np.int64)
        for k, own in _in_order(bucket):
            yield k, packed(slab.doc[own], slab.at[own], slab.hashes[own]), None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for slab in filter(None, _slabs(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows(slab)), kinds)],
                ["bucket", "blob", "doc_id", "start", "size"])

    return thin(docs, "doc_id", "text").mapInArrow(
        run, "bucket bigint, blob binary, doc_id bigint, start bigint, size bigint")


def _in_order(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different key with the places where it stands, in their order."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        yield int(keys[order[a]]), order[a:b]


def _meet(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a group's windows that a smaller document holds too."""
    doc, at, hashes = (np.concatenate(x) for x in zip(*map(unpacked, blobs)))
    order = np.argsort(hashes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
    least = np.minimum.reduceat(doc[order], starts)
    again = np.empty(len(doc), bool)
    again[order] = doc[order] > np.repeat(least, np.diff(np.append(starts, len(order))))
    return runs(doc[again], at[again])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known repeats pass through; the packed windows of a group meet."""
    names = ["doc_id", "start", "size"]
    at, blobs = None, []

    def meet() -> Iterator[pa.RecordBatch]:
        found = _meet(blobs) if blobs else [()]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names)

    for batch in batches:
        known = batch.filter(batch.column("blob").is_null()).select(names)
        if known.num_rows:
            yield known
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
            if not blob.is_valid:
                continue
            if bucket != at:
                yield from meet()
                at, blobs = bucket, []
            blobs.append(blob.as_py())
    yield from meet()


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, start, size``: runs of windows that a smaller document holds too.

    The number of buckets follows ``spark.sql.shuffle.partitions``, which a cluster
    sets by its input; a group's windows meet in memory. The texts are read twice: to
    count, and to deal.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = windows(docs, splits(docs, SPREAD * parts)).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_answers, "doc_id bigint, start bigint, size bigint")


def kept_words(raw: bytes, found: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words that no interval covers, and how many there were."""
    words = raw.split()
    keep, upto = [], 0
    for start, size in sorted(found):
        keep += words[upto:start] if start > upto else []
        upto = max(upto, start + size + WINDOW - 1)
    return keep + words[upto:], len(words)


def with_intervals(docs: DataFrame) -> DataFrame:
    """``doc_id, text, found``: texts with their runs of repeated windows."""
    found = repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("found"))
    return thin(docs, "doc_id", "text").join(found, "doc_id", "left")


def _kept(batch: pa.RecordBatch) -> list[tuple[list[bytes], int]]:
    return [
        kept_words(raw, [(x["start"], x["size"]) for x in found or ()])
        for raw, found in zip(raw_texts(batch), batch.column("found").to_pylist())]


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with repeated passages removed, words joined by one space."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([b" ".join(k).decode() for k, _ in _kept(batch)])],
            ["doc_id", "text"])

    return map_batches(with_intervals(docs), work, "doc_id bigint, text string")


def removal_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document.

    A null text counts as empty. A row with a null id keeps its words and takes none
    from others, since it has no place in the order; rows of one id count as one
    document and do not take from each other. An empty table gives an empty one.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _kept(batch)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([n for _, n in rows], pa.int64()),
             pa.array([n - len(k) for k, n in rows], pa.int64()),
             pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in rows], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(with_intervals(docs), work,
                       "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
