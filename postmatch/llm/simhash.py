"""Near copies by SimHash: fingerprints, a binary trie self-join, and components.

Fingerprints differ in at most three bits when linked. Of five blocks of bits at least
two are then equal, so a link is found in one of the ten groups that a pair of equal
blocks names. In a group, two tries (a chunk of the group and another, or the same one
twice) are walked together: a pair of nodes carries the bits by which it differs so
far, and is left as soon as these exceed three. Groups above ``CHUNK`` fingerprints
are dealt into chunks by hash, and each pair of chunks is a task's unit of its own.

A unit returns a forest that connects what it found linked, never all links, so a
large group of near copies adds rows in proportion to its fingerprints. Components
come from rounds of joins and minima over these few links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import free_name, map_batches, raw_texts, staged, thin

BITS = 64
ERRORS = 3
BLOCKS = 5
CHUNK = 2048
WIDTH = 3
SEED = 42
#: Shingles whose bits are counted at once.
SLICE = 1 << 15

#: Blocks of 13, 13, 13, 13 and 12 bits, as (lowest bit, width).
SPANS = [(lo, min(13, BITS - lo)) for lo in range(0, BITS, 13)]
PAIRS = list(itertools.combinations(range(BLOCKS), BLOCKS - ERRORS))


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """SimHash of the word shingles of a text in UTF-8, A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, SLICE):
        part = hashes[k:k + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > n, bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its fingerprint as a bigint of the same 64 bits."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(raw) for raw in raw_texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return map_batches(thin(docs, "doc_id", "text"), work, "doc_id bigint, fp bigint")


def group_key(fp: Column, pair: tuple[int, int]) -> Column:
    """The two blocks of bits that a group has in common, and which two they are."""
    key = F.lit(PAIRS.index(pair)).cast("bigint")
    for block in pair:
        low, width = SPANS[block]
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        key = F.shiftleft(key, width).bitwiseOR(part)
    return key


def trie_join(left: np.ndarray, right: np.ndarray, same: bool,
              errors: int = ERRORS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in two sorted arrays whose values differ in few bits.

    A trie node is a run of a sorted array that shares its leading bits. All node pairs
    of one depth are walked at once; each splits into up to four, those that exceed the
    budget are dropped, and small ones are compared value by value. With ``same`` both
    arrays are one, and every pair of nodes is met once.
    """
    small = 8
    nodes = np.array([[0, len(left), 0, len(right), 0]], np.int64)
    for depth in range(BITS - 1, -1, -1):
        if not len(nodes):
            return
        done = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= small * small
        for a, b, c, d, _ in nodes[done]:
            apart = np.bitwise_count(left[a:b, None] ^ right[None, c:d])
            i, j = np.nonzero(apart <= errors)
            if len(i):
                yield i + a, j + c
        nodes = nodes[~done]
        if not len(nodes):
            return
        bit = np.uint64(1 << depth)
        ones_left = np.concatenate([[0], np.cumsum((left & bit) != 0)])
        ones_right = np.concatenate([[0], np.cumsum((right & bit) != 0)])
        a, b, c, d, spent = nodes.T
        middle = b - (ones_left[b] - ones_left[a])
        centre = d - (ones_right[d] - ones_right[c])
        split = np.concatenate([
            np.stack([x, y, z, w, spent + cost], 1)
            for (x, y), (z, w), cost in (
                ((a, middle), (c, centre), 0), ((middle, b), (centre, d), 0),
                ((a, middle), (centre, d), 1), ((middle, b), (c, centre), 1))])
        nodes = split[(split[:, 0] < split[:, 1]) & (split[:, 2] < split[:, 3])
                      & (split[:, 4] <= errors) & ((not same) | (split[:, 0] <= split[:, 2]))]
    for a, b, c, d, _ in nodes:  # equal to the last bit, but for the errors spent
        i, j = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
        yield i.ravel(), j.ravel()


def forest(left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect all values found linked, one per value at most."""
    values = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    label = np.arange(len(values))
    links: list[tuple[int, int]] = []
    for i, j in trie_join(left, left if right is None else right, right is None):
        j = j + shift
        while len(new := np.flatnonzero(label[i] != label[j])):
            a, b = label[i[new[0]]], label[j[new[0]]]
            links.append((int(values[i[new[0]]]), int(values[j[new[0]]])))
            label[label == a] = b
            i, j = i[new], j[new]
        if len(links) == len(values) - 1:
            break
    return links


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints ``fp`` of a table."""
    keyed = prints.select("fp", F.explode(F.array(
        *(group_key(F.col("fp"), p) for p in PAIRS))).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1").withColumn(
        "chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    units = (
        keyed.join(sizes, "key").withColumn("mine", mine)
        .select("fp", "key", "mine", F.explode(every).alias("other"))
        .select("fp", "key", F.least("mine", "other").alias("low"),
                F.greatest("mine", "other").alias("high"), "mine")
    )
    work = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    return work.select("fp", "key", "low", "high", "mine").mapInArrow(_walk, "a bigint, b bigint")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins every unit of a partition sorted by unit; a unit has 2 CHUNK rows or so."""
    rest: np.ndarray | None = None
    names = ["fp", "key", "low", "high", "mine"]
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            block, rest = rest, None
        else:
            block = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names], 1)
            block = block if rest is None else np.concatenate([rest, block])
        if block is None or not len(block):
            continue
        cuts = np.flatnonzero(np.any(block[1:, 1:4] != block[:-1, 1:4], axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(block)]
        if batch is not None:  # the last unit may go on in the next batch
            rest, bounds = block[bounds[-2]:], bounds[:-1]
        found: list[tuple[int, int]] = []
        for start, end in zip(bounds, bounds[1:]):
            if end - start > 1:
                unit = block[start:end]
                values = unit[:, 0].astype(np.int64).view(np.uint64)
                _, _, low, high, _ = unit[0]
                if low == high:
                    found += forest(np.sort(values), None)
                else:
                    own = unit[:, 4] == low
                    found += forest(np.sort(values[own]), np.sort(values[~own]))
        if found:
            pairs = np.array(found, np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``a, b``: the least node that it reaches.

    Rounds of two steps, each of which keeps what is connected: every node's larger
    neighbours go to its least neighbour, then its smaller ones do. The links end as
    stars around the least nodes. Each round is written, so no lineage grows.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a <> b").distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = edges.unionAll(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionAll(least.select("a", F.col("m").alias("b")))
                       .where("a <> b").distinct(), "links")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    A null or empty text has fingerprint zero, which is linked like any other. Rows
    with a null id take part, and get the component of their group; where a group has
    no other rows that is null. Equal rows give equal rows; an empty table gives an
    empty one.
    """
    prints = staged(fingerprints(docs), "prints")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = connected(links(own.select("fp")))
    placed = own.join(stars, own.fp == stars.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = staged(placed, "placed")
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    members = placed.join(heads, "root").select("fp", "component_id")
    return prints.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component.

    That is the document of the smallest id. Equal rows become one; rows of one id
    with different texts are one document and stay or go together. Rows with a null id
    stay, since nothing tells which of them would stand for a group.
    """
    found = components(docs)
    own = free_name(docs, "_kept_id")
    kept = staged(found.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct(), "kept")
    stay = docs.join(kept, F.col("doc_id") == F.col(own), "left_semi")
    return stay.dropDuplicates(["doc_id", "text"]).unionAll(docs.where("doc_id IS NULL"))
