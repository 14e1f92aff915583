"""Hard negatives of anchors by Fagin's threshold algorithm over sorted dimensions.

All rows are dealt evenly into blocks that are written once: for every dimension a list of
the block's rows sorted by that component, beside the components themselves. A query walks
the lists of its anchor's non-zero components, each from the end that its sign asks for
(sorted access). Rows met first are scored in whole numbers (random access). No row that
was not met scores above the threshold, the sum over the lists of anchor times the last
component read. A window of scores is done when the threshold lies strictly below its kth
score, or below the window where it holds fewer, so that ties are met as well. Blocks
answer by themselves and their answers merge to the best k by score, then id.

A first pass finds each anchor's positives, a second one the negatives in the window that
each positive's score sets. Anchors travel in groups of bounded size, each group as one
value past all blocks: no row is shuffled for a query, and a task holds one block and one
group, whatever ids, labels or vectors are frequent.

Defined results: rows take no part that have a null id, label, vector or component, or a
component that is no finite number. A vector counts as zero beyond its end. Other rows of
an anchor are those with another id; each row that repeats counts for itself among
positives and negatives, and equal anchor rows are one anchor. An anchor without positives
or a window without negatives gives no row. Extra columns are not looked at, and an empty
table gives an empty one. An inner product of rows to compare that a long cannot hold
stops the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import staged
from postmatch.operators.skew import top_per_group

#: Rows of a block and anchors of a group at most, and bytes of their components about.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 16 << 20
GROUP_ROWS, GROUP_BYTES = 8_192, 8 << 20
#: Entries of each list read in the first step; each step doubles the depth.
FIRST_DEPTH = 32
#: Windows whose answers are sent on together.
AT_ONCE = 4_096
#: Whole numbers below this are exact as doubles.
EXACT = 2.0 ** 53

BLOCK_SCHEMA = "size bigint, width bigint, ids binary, labels binary, parts binary, lists binary"
BLOCK_ARROW = pa.schema([(n, pa.int64()) for n in ("size", "width")]
                        + [(n, pa.binary()) for n in ("ids", "labels", "parts", "lists")])
FOUND_SCHEMA = "no bigint, window bigint, score bigint, vec_id bigint"
FOUND_ARROW = pa.schema([(n, pa.int64()) for n in ("no", "window", "score", "vec_id")])


def whole_rows(table: DataFrame, relabel: int | None = None, classes: int = 10,
               scale: int = 256) -> DataFrame:
    """Rows that take part, their components as whole numbers ``floor(scale * x)``.

    Where ``relabel`` divides an id, its label becomes the next of ``classes``.
    """
    named = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND abs(x) < DOUBLE('Infinity'))")
    label = F.col("label")
    if relabel:
        label = F.when(F.col("vec_id") % relabel == 0, (label + 1) % classes).otherwise(label)
    # From 2^53 on a double is whole, and its floor might not fit a long.
    parts = f"transform(embedding, x -> IF(abs({scale}D * x) < {EXACT}D, DOUBLE(floor({scale}D * x)), {scale}D * x))"
    return (named.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
            .select("vec_id", label.alias("label"), F.expr(parts).alias("parts")))


def measured(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows, bytes of their components, and the most components of a row."""
    size = F.size("parts")
    got = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    return got[0], 8 * got[1], got[2]


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, zero beyond their ends."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def packed(part: pa.Table) -> pa.RecordBatch:
    """A block as one row."""
    column = part.column("parts").combine_chunks()
    width = int(np.diff(column.offsets.to_numpy()).max())
    parts = matrix(column, width)
    lists = np.argsort(parts, axis=0, kind="stable").T.astype(np.uint16)
    ids, labels = (part.column(n).to_numpy().astype(np.int64) for n in ("vec_id", "label"))
    row = [len(parts), width, *(x.tobytes() for x in (ids, labels, parts, lists))]
    return pa.record_batch([pa.array([x], t) for x, t in zip(row, BLOCK_ARROW.types)], schema=BLOCK_ARROW)


def sorted_blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """All rows in blocks of bounded size with their sorted lists, written once."""
    count, _, width = measured(rows)
    most = max(1, min(most, BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, most - size)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                size += piece.num_rows
                if size == most:
                    yield packed(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    # Round robin: no column decides where a row goes, so nothing can make a block large.
    even = rows.repartition(max(1, ceil(count / most)))
    return staged(even.mapInArrow(run, BLOCK_SCHEMA), "vector-blocks")


def exact(values: np.ndarray) -> np.ndarray:
    """Whole doubles as whole numbers of any size."""
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


class Block:
    """One block as arrays, and the walk of a query over its lists."""

    def __init__(self, size: int, width: int, ids, labels, parts, lists):
        self.size = size
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.parts = np.frombuffer(parts).reshape(size, width)
        self.lists = np.frombuffer(lists, np.uint16).reshape(width, size)
        self.largest = float(np.abs(self.parts).max(initial=1.0))

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Step by step: rows met, their scores, and the threshold for all others."""
        weights = np.zeros(self.parts.shape[1])
        weights[:len(anchor)] = anchor[:len(weights)]
        parts = self.parts
        if self.largest * float(np.abs(weights).sum()) >= EXACT:
            weights, parts = exact(weights), exact(parts)
        up, down = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        if not len(up) and not len(down):
            # Nothing tells rows apart: all score zero.
            yield np.arange(self.size), np.zeros(self.size, np.int64), -np.inf
            return
        met = np.zeros(self.size, bool)
        done, depth = 0, min(FIRST_DEPTH, self.size)
        while True:
            seen = np.zeros(self.size, bool)
            seen[self.lists[up, self.size - depth:self.size - done]] = True
            seen[self.lists[down, done:depth]] = True
            seen &= ~met
            met |= seen
            fresh = np.flatnonzero(seen)
            scores = parts[fresh] @ weights
            last = np.concatenate((parts[self.lists[up, self.size - depth], up],
                                   parts[self.lists[down, depth - 1], down]))
            bound = last @ np.concatenate((weights[up], weights[down]))
            over = depth == self.size or met.all()
            yield fresh, scores, -np.inf if over else bound
            if over:
                return
            done, depth = depth, min(2 * depth, self.size)

    def best(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[float, float]],
             k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the ids and scores of the first ``k`` ``wanted``
        rows in it."""
        out = [(np.zeros(0, np.int64),) * 2] * len(windows)
        still = {n: w for n, w in enumerate(windows) if w[0] <= w[1]}
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for fresh, score, bound in self.walk(anchor):
            use = wanted[fresh]
            rows = np.concatenate((rows, fresh[use]))
            scores = np.concatenate((scores, score[use].astype(np.int64)))
            if not any(bound < high for _, high in still.values()):
                continue
            for number, (low, high) in list(still.items()):
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                held = scores[inside]
                kth = np.partition(held, len(held) - k)[len(held) - k] if len(held) >= k else low
                if bound < kth or bound == -np.inf:
                    inside = inside[held >= kth]
                    ids, reached = self.ids[rows[inside]], scores[inside]
                    first = np.lexsort((ids, -reached))[:k]
                    out[number] = ids[first], reached[first]
                    del still[number]
            if not still:
                break
        return out


def search(blocks: DataFrame, anchors: DataFrame, k: int, same_label: bool,
           group_rows: int = GROUP_ROWS) -> DataFrame:
    """The first ``k`` rows of every block for every window of every anchor.

    An anchor has ``no``, ``vec_id``, ``label``, ``parts`` and ``windows``, an array of
    numbers and bounds. Its own label is asked for, or all others.
    """
    count, width, _ = measured(anchors)
    groups = max(1, ceil(count / group_rows), ceil(width / GROUP_BYTES))
    own = F.pmod(F.xxhash64("no"), F.lit(groups))

    def answers(block: Block, group: pa.StructArray) -> Iterator[tuple[np.ndarray, ...]]:
        """Number, window, scores and ids, each as an array, for anchor after anchor."""
        nos, ids, labels, windows = (group.field(n).to_pylist() for n in ("no", "vec_id", "label", "windows"))
        parts = group.field("parts")
        for place, (no, vec_id, label, asked) in enumerate(zip(nos, ids, labels, windows)):
            bounds = [(-np.inf if w["low"] is None else w["low"], np.inf if w["high"] is None else w["high"])
                      for w in asked]
            same = block.labels == label
            wanted = same & (block.ids != vec_id) if same_label else ~same
            anchor = parts[place].values.to_numpy(zero_copy_only=False)
            for window, (found, scores) in zip(asked, block.best(anchor, wanted, bounds, k)):
                yield np.full(len(found), no), np.full(len(found), window["number"]), scores, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                size, width, *arrays, group = (batch.column(n)[r] for n in (*BLOCK_ARROW.names, "anchors"))
                block = Block(size.as_py(), width.as_py(), *(x.as_buffer() for x in arrays))
                found = answers(block, group.values)
                while some := list(islice(found, AT_ONCE)):
                    columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*some)]
                    yield pa.record_batch(columns, schema=FOUND_ARROW)

    def of_group(number: int) -> DataFrame:
        packed_group = anchors.where(own == number).agg(F.collect_list(
            F.struct("no", "vec_id", "label", "parts", "windows"))).scalar()
        return blocks.withColumn("anchors", packed_group).mapInArrow(run, FOUND_SCHEMA)

    return reduce(DataFrame.unionAll, map(of_group, range(groups)))


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS,
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """For the anchors, the rows whose id ``every`` divides, and each of their first
    ``positives`` rows of the same label: the first ``negatives`` rows of other labels
    that score from ``low`` to ``high`` per cent of the positive.

    ``rows`` come from :func:`whole_rows`.
    """
    blocks = sorted_blocks(rows, block_rows)
    anchors = staged(rows.where(F.col("vec_id") % every == 0).distinct()
                     .withColumn("no", F.monotonically_increasing_id()), "anchors")
    best = [F.desc("score"), F.asc("vec_id")]
    everything = F.expr("array(named_struct('number', 0L, 'low', CAST(NULL AS BIGINT), 'high', CAST(NULL AS BIGINT)))")
    same = search(blocks, anchors.withColumn("windows", everything), positives, True, group_rows)
    chosen = staged(
        top_per_group(same, ["no"], best, positives).select(
            "no", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score")), "positives")
    # Positives of one score share a window, which that score numbers.
    score = "DECIMAL(38, 0)"
    windows = chosen.groupBy("no").agg(F.collect_set("positive_score").alias("scores")).withColumn("windows", F.expr(
        f"transform(scores, s -> named_struct('number', s, 'low', CAST(ceil(CAST(s AS {score}) * {low} / 100) AS BIGINT), "
        f"'high', CAST(floor(CAST(s AS {score}) * {high} / 100) AS BIGINT)))"))
    other = search(blocks, anchors.join(windows.drop("scores"), "no"), negatives, False, group_rows)
    found = top_per_group(other, ["no", "window"], best, negatives).select(
        "no", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return (chosen.join(found, ["no", "positive_score"])
            .join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ORACLE = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.parts, b.parts), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
