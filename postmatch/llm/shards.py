"""Shards along a Hilbert curve over several dimensions of the documents' metadata.

Each dimension is cut into equally filled bins: numbers at approximate quantiles, strings
at the whole strings where equal shares of the rows end. The bins of a row are a cell of a
grid, and the curve's number of the cell orders the rows, so a run of rows is compact in
all dimensions at once and a reader can skip files by any of them. Runs of equal numbers
of rows (at most one apart) become the shards.

Rows are ordered by a range exchange that ties are broken in by text checksum and id,
so a cell that holds a third of all rows is dealt over as many tasks as it needs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmatch.llm.common import staged

SHARDS = 40
BITS = 5
#: Columns whose values order the rows; the size of the text comes first.
DIMENSIONS = ("lang", "source")
OVERHEAD = 16


def curve_numbers(cells: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """The position along a Hilbert curve of each cell of a grid of 2**bits a side."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, from the largest
        low = q - 1
        for i in range(n):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_bit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> bit) & 1)
    return out


def string_edges(rows: DataFrame, name: str, bits: int = BITS) -> list[str]:
    """The strings at which equal shares of the rows end, by whole strings and exact.

    Rows are counted by string first; the strings are then ordered by a range exchange
    and their counts summed up within its tasks and over them.
    """
    parts = 1 << bits
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    ordered = staged(counts.repartitionByRange(name).withColumn("part", F.spark_partition_id()), "strings")
    within = F.sum("n").over(Window.partitionBy("part").orderBy(name))
    over_all = Window.orderBy("part")
    starts = ordered.groupBy("part").agg(F.sum("n").alias("m")).select(
        "part", (F.sum("m").over(over_all) - F.col("m")).alias("before"),
        F.sum("m").over(over_all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    reached = ordered.withColumn("upto", within).join(F.broadcast(starts), "part").withColumn("upto", F.expr("before + upto"))
    ends = reached.where(f"least({parts - 1}, upto * {parts} div total) > (upto - n) * {parts} div total")
    return sorted((r[0] for r in ends.select(name).collect()), key=str.encode)


def string_cell(column: Column, edges: list[str], bits: int = BITS) -> Column:
    """The bin of a string: how many edges lie before it, spread over the grid's side."""
    before = F.lit(0)
    for edge in edges:
        before = before + (column > F.lit(edge)).cast("int")
    return F.floor(before * (1 << bits) / (len(edges) + 1)).cast("int")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def on_curve(rows: DataFrame, number: str, strings: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve``, from bins of a numeric column and of string columns."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.agg(F.percentile_approx(number, shares, 1000)).first()[0]
    edges = np.unique(np.array(found or [], np.int64))
    cells = [string_cell(F.col(n), string_edges(rows, n, bits), bits) for n in strings]

    @F.pandas_udf("bigint")
    def curve(numbers: pd.Series, *others: pd.Series) -> pd.Series:
        # Few different values are spread over the side: each counts as much as any dimension.
        first = (np.searchsorted(edges, numbers.to_numpy(), side="left") << bits) // (len(edges) + 1)
        return pd.Series(curve_numbers([first, *(c.to_numpy() for c in others)], bits))

    return rows.withColumn("curve", curve(F.col(number), *cells))


def sharded(docs: DataFrame, shards: int = SHARDS, dimensions=DIMENSIONS, whole: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row, and ``row`` if ``whole``.

    A null text has no bytes; a null dimension counts as empty and comes first. Rows with a null id or with
    equal ids are dealt like any other; which of two equal rows comes first does not
    matter. An empty table gives an empty one.
    """
    rows = docs.select(
        F.col("doc_id"),
        text_size(F.col("text")).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        *(F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("")).alias(f"d{k}") for k, d in enumerate(dimensions)),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []),
    )
    order = ["curve", "text_crc32", "doc_id"]
    placed = on_curve(staged(rows, "measured"), "size", [f"d{k}" for k in range(len(dimensions))])
    ordered = staged(
        placed.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ordered")
    # One row for each task of the exchange: where its rows start, and how many there are.
    whole_order = Window.orderBy("part")
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(whole_order) - F.col("n")).alias("before"),
        F.sum("n").over(whole_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rank, few = F.col("before") + F.col("at"), F.expr(f"total div {shards}")
    more = F.col("total") % shards
    edge = more * (few + 1)
    late = F.expr(f"(before + at - (total % {shards}) * (total div {shards} + 1)) div greatest(total div {shards}, 1)")
    early = F.expr(f"(before + at) div (total div {shards} + 1)")
    shard = F.when(rank < edge, early).otherwise(more + late)
    return (
        ordered.join(F.broadcast(starts), "part")
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", rank - F.col("shard") * few - F.least(F.col("shard").cast("bigint"), more))
        .select("doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if whole else []))
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions=DIMENSIONS) -> None:
    """One folder per shard with whole rows in slot order."""
    rows = sharded(docs, shards, dimensions, whole=True).select("shard", "slot", "row.*")
    (rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
     .drop("slot").write.partitionBy("shard").parquet(path))


def shard_rows(docs: DataFrame) -> DataFrame:
    """The shards of the ``rows`` law in the columns that all shard laws share."""
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
