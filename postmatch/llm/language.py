"""Language-model scores from an n-gram trie in Elias-Fano form.

Level one holds every word of the training texts as its hash, in order, with its count;
a word's place is its number. Level two holds every pair of words under its first word:
a monotone pointer per context gives where its followers start, the followers' numbers
are one monotone sequence, and each has its discounted probability in eight bits. A pair is
looked up by the successor of the follower's number relative to its context, between
two pointers. The levels are files in the shared folder, cut into shards by hash; tasks
map them into memory, so what a machine holds of them is its page cache.

Words are counted in Spark and numbered; pairs are counted by each task for as many
texts as fit a slice of its input, packed, and summed by shard. No count is dropped. The followers of a
frequent context would be one large group: they are dealt over all shards by their own
numbers, and what the shards leave of such a context for single words is summed.

Smoothing is absolute discounting: every pair gives up the same part of a count,
PAIR_DISCOUNT, however many shards there are, and what is taken from a context's pairs goes
to the words' own distribution, which keeps a share for unknown words.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import fresh_path, local_path, slices, thin
from postmatch.llm.eliasfano import Sequence, encoded, load, save

#: Stands for the end of a text, and before its first word; white space is in no word.
END = b"\n"
SEED = 42
#: Words of a shard that can be hot contexts; it would be rare that it had more.
OFTEN = 16
#: Shards for each shuffle partition.
SPREAD = 4
#: Words that a task remembers.
REMEMBERED = 400_000
#: Log probabilities from 0 down to this are kept in 255 steps.
LEAST = -10.0
STEPS = 255
PROBABILITIES = 10 ** (np.arange(STEPS + 1) * (LEAST / STEPS))
SHIFT = 1 << 63
#: Discount of single words.
WORD_DISCOUNT = 0.5
#: What each pair gives up; a constant, so that no score follows the number of shards.
PAIR_DISCOUNT = 0.75


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 10 == 0, F.lit(False))


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All tokens of a batch as places in a list of its different words, an end after
    each text; the tokens of each text; and that list.

    Arrow's ASCII functions lower-case A-Z and cut at ``[\\x20\\x09-\\x0D]`` alone.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[full]
    coded = words.filter(pa.array(full)).dictionary_encode()
    known = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
    places = np.full(len(text) + len(lists), len(known) - 1, np.int64)
    places[np.arange(len(text)) + text] = coded.indices.to_numpy(zero_copy_only=False)
    return places, np.bincount(text, minlength=len(lists)) + 1, known


def hashed(words: list[bytes]) -> np.ndarray:
    """The hashes that Spark's ``xxhash64`` gives, as unsigned numbers."""
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: how often each token of the training texts occurs, by its hash. Tasks
    count what they read before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            places, _, known = tokens_of(batch)
            counts = np.bincount(places, minlength=len(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed(known).view(np.int64)), pa.array(counts)], ["h", "c"])

    rows = docs.where(~held_out(F.col("doc_id"))).select("text")
    return rows.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key of batches that are sorted by it."""
    at, held = None, []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if keys[a] != at:
                if held:
                    yield at, pa.Table.from_batches(held)
                at, held = int(keys[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


class Model(NamedTuple):
    """What a task needs to open the trie; ``hot`` holds frequent contexts' numbers in
    order, and what is left of each for single words."""

    folder: str
    starts: list[int]
    total: int
    shards: int
    hot: list[int] = []
    hot_rest: list[float] = []


def write_words(docs: DataFrame, folder: str, shards: int) -> Model:
    """Writes level one. Words that make up more than a shard's share of all tokens are
    hot: as contexts they are dealt over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_key(batches, "shard"):
            hashes = rows.column("h").to_numpy().view(np.uint64) ^ np.uint64(SHIFT)
            counts = rows.column("c").to_numpy()
            arrays, facts = encoded(hashes, 2**64 - 1)
            kind = np.uint32 if counts.max() < 1 << 32 else np.int64
            save(f"{folder}/words-{shard}", {**arrays, "counts": counts.astype(kind)}, facts)
            often = np.argsort(-counts, kind="stable")[:OFTEN]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([len(counts)], pa.int64()),
                 pa.array([int(counts.sum())], pa.int64()), pa.array([often], pa.list_(pa.int64())),
                 pa.array([counts[often]], pa.list_(pa.int64()))], ["shard", "n", "tokens", "often", "counts"])

    # Equal ranges of the hash, by its first 16 bits.
    counted = token_counts(docs).withColumn(
        "shard", F.expr(f"shiftright((shiftright(h, 48) + 32768) * {shards}, 16)"))
    done = counted.repartition("shard").sortWithinPartitions("shard", "h").mapInArrow(
        run, "shard bigint, n bigint, tokens bigint, often array<bigint>, counts array<bigint>"
    ).collect()  # one row per shard
    sizes = {r.shard: r.n for r in done}
    starts = [0, *itertools.accumulate(sizes.get(k, 0) for k in range(shards))]
    total = sum(r.tokens for r in done)
    hot = [starts[r.shard] + at for r in done for at, c in zip(r.often, r.counts) if c * shards > total]
    return Model(folder, starts, total, shards, sorted(hot))


def parts_of(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different key with the places where it stands."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        yield int(keys[order[a]]), order[a:b]


class Words:
    """Level one: numbers and counts of words. Unknown words have the number ``size``."""

    def __init__(self, folder: str, starts: list[int], total: int):
        self.folder, self.starts, self.total = folder, np.array(starts), total
        self.size, self.opened = int(starts[-1]), {}

    def shard(self, k: int) -> tuple[Sequence, np.ndarray]:
        if k not in self.opened:
            arrays, facts = load(f"{self.folder}/words-{k}")
            self.opened[k] = Sequence(arrays, facts), arrays["counts"]
        return self.opened[k]

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and counts of some words."""
        hashes = hashed(words) ^ np.uint64(SHIFT)
        number = np.full(len(words), self.size, np.int64)
        count = np.zeros(len(words), np.int64)
        shards = ((hashes >> np.uint64(48)).astype(np.int64) * (len(self.starts) - 1)) >> 16
        for k, rows in parts_of(shards):
            if self.starts[k] < self.starts[k + 1]:
                sequence, counts = self.shard(k)
                found = sequence.find(hashes[rows])
                rows, found = rows[found >= 0], found[found >= 0]
                number[rows], count[rows] = found + self.starts[k], counts[found]
        return number, count

    def number_of(self, word: bytes) -> int:
        return int(self.look_up([word])[0][0])

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """The counts of some numbers; 0 for the unknown."""
        out = np.zeros(len(numbers), np.int64)
        for k, rows in parts_of(np.searchsorted(self.starts, numbers, side="right") - 1):
            if k < len(self.starts) - 1:
                out[rows] = self.shard(k)[1][numbers[rows] - self.starts[k]]
        return out


def pairs_of(tokens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context and the token; the first of a text follows an end."""
    return np.concatenate([[end], tokens[:-1]]), tokens


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, and counts; compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    body = np.ascontiguousarray(steps.T).tobytes() + counts.astype(np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = len(body) // 12
    steps = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n).reshape(8, n).T)
    return np.cumsum(steps.view(np.uint64).ravel()), np.frombuffer(body, np.uint32, n, 8 * n).astype(np.int64)


def first_of(shard: np.ndarray, size: int, shards: int) -> np.ndarray:
    """The least number of each shard of contexts."""
    return -(-(shard * size) // shards)


def hot_index(hot: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Which hot context each one is, or -1."""
    if not len(hot):
        return np.full(len(contexts), -1, np.int64)
    at = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
    return np.where(hot[at] == contexts, at, -1)


def write_pairs(docs: DataFrame, model: Model) -> Model:
    """Writes level two; returns the model with what is left of the hot contexts."""
    folder, starts, total, shards, hot, _ = model
    size = starts[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, often = Words(folder, starts, total), np.array(hot, np.int64)
        for batch in slices(batches, 2):
            places, _, known = tokens_of(batch)
            number, _ = level.look_up(known)
            before, token = (number[x] for x in pairs_of(places, len(known) - 1))
            keys, n = np.unique(before.astype(np.uint64) * np.uint64(size) + token.astype(np.uint64),
                                return_counts=True)
            context = (keys // np.uint64(size)).astype(np.int64)
            follower = (keys - context.astype(np.uint64) * np.uint64(size)).astype(np.int64)
            shard = np.where(hot_index(often, context) >= 0, follower, context) * shards // size
            own = list(parts_of(shard))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in own], pa.int64()),
                 pa.array([packed(keys[rows], n[rows]) for _, rows in own], pa.binary())],
                ["shard", "blob"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, often = Words(folder, starts, total), np.array(hot, np.int64)
        for shard, rows in by_key(batches, "shard"):
            keys, n = (np.concatenate(x) for x in zip(*(
                unpacked(b.as_py()) for b in rows.column("blob"))))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
            left = write_shard(level, folder, shard, shards, often, keys[first], np.add.reduceat(n, first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(often), pa.array(left)], ["context", "rest"])

    rows = docs.withColumn("held_out", held_out(F.col("doc_id"))).where("NOT held_out")
    left = rows.mapInArrow(count, "shard bigint, blob binary").repartition("shard").sortWithinPartitions(
        "shard").mapInArrow(write, "context bigint, rest double").groupBy("context").agg(F.sum("rest").alias("rest"))
    rest = {r.context: r.rest for r in left.collect()}  # one row per hot context
    return model._replace(hot_rest=[rest.get(k, 0.0) for k in hot])


def write_shard(level: Words, folder: str, shard: int, shards: int, hot: np.ndarray,
                keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Writes a shard's followers: of its own contexts, then of the hot ones. Returns the
    share that the shard takes from each hot context."""
    size = level.size
    low = int(first_of(np.int64(shard), size, shards))
    contexts = int(first_of(np.int64(shard + 1), size, shards)) - low
    context = (keys // np.uint64(size)).astype(np.int64)
    token = keys - context.astype(np.uint64) * np.uint64(size)
    which = hot_index(hot, context)
    local = np.where(which >= 0, contexts + which, context - low)
    relative = local.astype(np.uint64) * np.uint64(size) + token
    order = np.argsort(relative, kind="stable")
    relative, local, n = relative[order], local[order], n[order]
    counts = level.counts(np.concatenate([np.arange(low, low + contexts), hot]))
    step = np.clip(np.rint(np.log10((n - PAIR_DISCOUNT) / counts[local]) / LEAST * STEPS), 0, STEPS).astype(np.uint8)
    pointers = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(local, minlength=len(counts)), out=pointers[1:])
    followers, facts = encoded(relative, len(counts) * size)
    starts, more = encoded(pointers, len(keys))
    save(f"{folder}/pairs-{shard}",
         {**{"f." + k: v for k, v in followers.items()}, **{"p." + k: v for k, v in starts.items()},
          "step": step},
         {"followers": facts, "pointers": more, "low": low, "contexts": contexts})
    return PAIR_DISCOUNT * np.diff(pointers)[contexts:] / np.maximum(counts[contexts:], 1)


def level_one(counts: np.ndarray, level: Words) -> np.ndarray:
    """Probability of single words by their counts; all unknown ones share one part."""
    spare = WORD_DISCOUNT * level.size / level.total
    return np.maximum(counts - WORD_DISCOUNT, 0) / level.total + spare / (level.size + 1)


class Trie:
    def __init__(self, model: Model):
        self.words, self.shards = Words(model.folder, model.starts, model.total), model.shards
        self.hot, self.hot_rest = np.array(model.hot, np.int64), np.array(model.hot_rest)
        self.folder, self.opened = model.folder, {}

    def shard(self, k: int):
        if k not in self.opened:
            path = f"{self.folder}/pairs-{k}"
            if not os.path.exists(path):  # no pair of this shard was seen
                self.opened[k] = None
            else:
                arrays, facts = load(path)
                pointers = Sequence(arrays, facts["pointers"], "p.")
                hot = pointers.at(facts["contexts"] + np.arange(len(self.hot) + 1)).astype(np.int64)
                self.opened[k] = (Sequence(arrays, facts["followers"], "f."), pointers,
                                  arrays["step"], facts, hot)
        return self.opened[k]

    def log_probs(self, before: np.ndarray, token: np.ndarray, before_counts: np.ndarray | None = None,
                  token_counts: np.ndarray | None = None) -> np.ndarray:
        """log10 P(token | before) for arrays of numbers; equal contexts stand together
        for speed."""
        size = self.words.size
        if before_counts is None:
            before_counts, token_counts = self.words.counts(before), self.words.counts(token)
        found, rest = np.zeros(len(token)), np.ones(len(token))
        first_rows = np.flatnonzero(np.diff(before, prepend=-1))
        each = np.diff(np.append(first_rows, len(before)))
        contexts = before[first_rows]
        which = hot_index(self.hot, contexts)
        home = np.where((which < 0) & (contexts < size), contexts * self.shards // max(size, 1), self.shards)
        for k, own in parts_of(home):
            part = self.shard(k) if k < self.shards else None
            if part is None:
                continue
            context = contexts[own] - part[3]["low"]
            first, end = (part[1].at(context + j).astype(np.int64) for j in (0, 1))
            seen = end > first
            own, context, first, end = own[seen], context[seen], first[seen], end[seen]
            rows = np.repeat(first_rows[own] - (np.cumsum(each[own]) - each[own]), each[own])
            rows += np.arange(len(rows))
            rest[rows] = np.repeat(
                PAIR_DISCOUNT * (end - first) / before_counts[first_rows[own]], each[own])
            self._followers(part, rows, token, found, *(np.repeat(x, each[own]) for x in (context, first, end)))
        which = np.repeat(which, each)
        rows = np.flatnonzero(which >= 0)
        if len(rows):
            rest[rows] = self.hot_rest[which[rows]]
            home = np.where(token[rows] < size, token[rows] * self.shards // max(size, 1), self.shards)
            for k, own in parts_of(home):
                part = self.shard(k) if k < self.shards else None
                if part is not None:
                    asked, start = which[rows[own]], part[4]
                    self._followers(part, rows[own], token, found, asked + part[3]["contexts"],
                                    start[asked], start[asked + 1])
        return np.log10(found + rest * level_one(token_counts, self.words))

    def _followers(self, part, rows, token, found, context, first, end) -> None:
        """Fills in what the pairs of some rows keep of their probability."""
        size = self.words.size
        known = np.flatnonzero(token[rows] < size)
        relative = context[known].astype(np.uint64) * np.uint64(size) + token[rows[known]].astype(np.uint64)
        place = part[0].find(relative, first[known], end[known])
        hit = place >= 0
        found[rows[known[hit]]] = PROBABILITIES[part[2][place[hit]]]


def build(docs: DataFrame) -> Model:
    """Trains on the texts that are not held out."""
    spark = docs.sparkSession
    shards = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = local_path(fresh_path(spark, "trie"))
    os.makedirs(folder)
    docs = thin(docs, "doc_id", "text")
    model = write_words(docs, folder, shards)
    return write_pairs(docs, model) if model.total else model


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null or empty text is one end. A null id is not held out; equal rows get equal
    scores. Without training texts no token is known, and each has probability one
    among the single unknown word. An empty table gives an empty one.
    """
    model = build(docs)
    total, vocabulary = model.total, model.starts[-1]
    rows = thin(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for batch in slices(batches, 2):
            places, sizes, known = tokens_of(batch)
            number, count = trie.words.look_up(known)
            before, token = pairs_of(places, len(known) - 1)
            keys, place = np.unique(before * len(known) + token, return_inverse=True)
            u, w = keys // len(known), keys % len(known)
            logs = trie.log_probs(number[u], number[w], count[u], count[w])[place] \
                if total else np.zeros(len(token))
            counts = count[token]
            base = np.log10((counts + 0.1) / (total + 0.1 * (vocabulary + 1)))
            at = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(sizes),
                 pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)),
                 pa.array(np.full(len(sizes), total, np.int64)),
                 pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double")
