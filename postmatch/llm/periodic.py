"""Periodic runs: stretches of words that repeat themselves, and texts without them.

The words of a text become numbers; suffixes that share words are sorted by prefix
doubling, and neighbours get their longest common prefix (LCP). Classes of suffixes, each
an ordered set of positions, are then united by decreasing LCP, as Kruskal unites trees.
Two positions i < j that become neighbours within a class by a union at LCP l agree on
exactly l words. If their distance is within l they seed a run of period j - i that ends
at j + l; it is whole if the words before i and j differ. Every run is found so: a
position of the class between its start and one period on would make the period smaller.

A run of MIN_LENGTH words and two periods has an LCP of half MIN_LENGTH or more, so
suffixes that share fewer words are not united.

Defined results: a null or empty text has no run and an empty collapsed text. A null id
is kept. Rows that repeat give one row each. Further columns are not looked at, and an
empty table gives an empty one. Texts of any length are read whole, in the memory of one
task: some 30 bytes a word, and 4 for each doubling while words still repeat.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.arrays import bind
from postmatch.llm.common import map_batches, raw_texts, thin, words

#: A run has at least so many words.
MIN_LENGTH = 12

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers that no two texts share, with a number of its
    own before, between and after the texts; and where each text starts."""
    ids, starts, used = [0], [], 1
    for text in texts:
        starts.append(len(ids))
        own: dict[bytes, int] = {}
        ids += [used + own.setdefault(word, len(own)) for word in text]
        used += len(own) + 1
        ids.append(used - 1)
    return np.array(ids, np.int64), np.array(starts, np.int64)


def starts_of(keys: np.ndarray) -> np.ndarray:
    """For each of some sorted keys the place where its equals start."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def shared_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by suffix, and the LCP of each with the one before.

    Left out are positions whose first words, as many as the largest power of two within
    ``least``, do not occur again.
    """
    total = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(total, np.int32)
    rank[order] = starts_of(ids[order])
    size, levels, shared = 1, [], order
    several = np.bincount(rank, minlength=total) > 1
    active = order[several[rank[order]]]
    while len(active):
        levels.append((size, rank.copy()))
        if size <= least:
            shared = active
        # What follows a repeated stretch is in the text, or its end: never further on.
        keys = rank[active].astype(np.int64) * total + rank[active + size]
        turn = np.argsort(keys, kind="stable")
        active, keys = active[turn], keys[turn]
        before = rank[active]
        first = starts_of(keys)
        rank[active] = before + (first - starts_of(before)).astype(np.int32)
        count = np.bincount(first, minlength=len(first))
        active = active[count[first] > 1]
        size *= 2
    if not levels or levels[-1][0] * 2 <= least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = shared[np.argsort(rank[shared], kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    here, before = order[1:].copy(), order[:-1].copy()
    for size, rank in reversed(levels):
        same = np.flatnonzero(rank[here] == rank[before])
        here[same] += size
        before[same] += size
        lcp[1:][same] += size
    return order, lcp


def unite(ids: np.ndarray, least: int, min_length: int) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs, by uniting suffix classes."""
    order, lcp = shared_suffixes(ids, least)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    root = list(range(len(order)))
    sets = [[p] for p in order.tolist()]
    runs = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, common in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = find(x - 1), find(x)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        root[b] = a
        large, small = sets[a], sets[b]
        sets[b] = None
        places = [bisect_left(large, p) for p in small]
        for k, (p, place) in enumerate(zip(small, places)):
            # Neighbours that come from one and the same class are no new ones.
            if place and (k == 0 or places[k - 1] < place):
                left = large[place - 1]
                if p - left <= common and ids[left - 1] != ids[p - 1] and p - left + common >= min_length:
                    runs.append((left, p - left + common, p - left))
            if place < len(large) and (k + 1 == len(small) or places[k + 1] > place):
                right = large[place]
                if right - p <= common and ids[p - 1] != ids[right - 1] and right - p + common >= min_length:
                    runs.append((p, right - p + common, right - p))
        if 16 * len(small) < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()
    return sorted((start, length, period) for start, length, period in runs)


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """For each text its runs, by start, then period."""
    ids, starts = numbered(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in unite(ids, (min_length + 1) // 2, min_length):
        text = int(np.searchsorted(starts, start, "right")) - 1
        out[text].append((start - int(starts[text]), length, period))
    return [sorted(own, key=lambda run: (run[0], run[2])) for own in out]


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return text
    keep = bytearray(b"\1") * len(text)
    for start, length, period in runs:
        keep[start + period:start + length] = bytes(length - period)
    return [word for word, kept in zip(text, keep) if kept]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, text: str = "text") -> DataFrame:
    """Per document its runs in ``runs``, numbered by words, and its text without
    what they repeat in ``collapsed``, words joined by one space."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x.split() for x in raw_texts(batch)]
        found = runs_of(texts, min_length)
        short = [b" ".join(collapsed(*both)) for both in zip(texts, found)]
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(rows, RUNS_ARROW), pa.array(short, pa.binary()).cast(pa.string())],
            ["doc_id", "runs", "collapsed"])

    own = thin(docs, "doc_id", text).toDF("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    return map_batches(own, work, f"doc_id {kind}, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the periodic tail that a tenth of the ids get, else as it is.

    With h = crc32 of the decimal id, g = h div 10, n words, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8): each word i from a on becomes word a + (i - a) mod p.
    A null id gets none.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    tail = bind(
        "x", "transform(x.words, (word, i) -> IF(i < x.g % size(x.words), word, get(x.words, CAST("
        "x.g % size(x.words) + (i - x.g % size(x.words)) % (1 + (size(x.words) - x.g % size(x.words)) "
        "DIV (3 + x.g % 8)) AS INT))))", words=words(text), g=F.floor(h / 10))
    return F.when(h % 10 == 0, F.array_join(tail, " ")).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text,
    of whole texts of which a tenth get a periodic tail first."""
    prepared = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(prepared)
    longest = F.array_max(F.expr(
        "transform(runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS short))"))
    lines = F.expr("transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n')")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.short")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.short")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
