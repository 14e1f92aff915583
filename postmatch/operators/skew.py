"""Joins and rankings that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, key: str, *, how: str, spread_by: str,
                hot_rows: int = 1_000_000) -> DataFrame:
    """Equi-join in which only the keys hot on the left are split.

    Keys with more than ``hot_rows`` left rows are found by a count that combines
    before its shuffle. Spark joins the few of them as their size allows. A hot key has a
    bucket for every ``hot_rows`` of its left rows, and only its right rows are
    repeated; all other rows keep bucket 0. The count reads ``left`` once more, for its
    key alone: pass a written table when it is costly.
    """
    hot = (
        left.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > hot_rows) & F.col(key).isNotNull())
        .select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    spread = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
        .drop("_salts")
    )
    repeated = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank", salts: int = 64) -> DataFrame:
    """The first ``k`` rows of every group, numbered from 1.

    A task's rows share one of ``salts`` buckets, and Spark cuts before each exchange:
    a task sends ``k`` rows of a group at most. A group that holds a third of the table
    is ranked by many tasks, and the last step sees at most ``k * salts`` of its rows.
    """
    bucket = F.pmod(F.spark_partition_id(), F.lit(salts))
    first = Window.partitionBy(*group, "_bucket").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_bucket", bucket)
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(last))
        .where(F.col(rank) <= k)
        .drop("_bucket")
    )
