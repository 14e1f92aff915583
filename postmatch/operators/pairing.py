"""Bring postings and profiles together.

Three exact ways:

* each posting with every profile: the profile table travels as one array from a
  scalar subquery and each posting is expanded over it, so the plan has no join and
  no exchange of postings;
* more profiles than one array may hold: the same for one block of profiles after
  another, so no posting is ever shuffled or repeated for a shuffle; with a ``stage`` both
  sides are made once and a block reads its part of the profiles alone. Blocks that are
  measured pass over the postings together, as many as one array may hold;
* a key such as the search a posting came from: an equi-join, broadcast behind a
  check of the profiles' size, else shuffled with hot keys split.

The size is that of the profiles' ids and texts: measuring it runs no encoder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.operators.skew import salted_join

MAX_PROFILES = 256
MAX_BYTES = 8 * 1024 * 1024
#: How columns of what is measured for a whole block of profiles begin.
MEASURED = "_measured_"
#: Spark's growing row ids count from 0 within a task in so many bits.
ROW_BITS = 33


def table_size(df: DataFrame) -> tuple[int, int]:
    """Row count and text-form size of a small table, by one aggregate row."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes"),
    ).first()
    return row["n"], row["bytes"]


def every_pair(postings: DataFrame, profiles: DataFrame, *, size: tuple[int, int] | None = None,
               max_profiles: int = MAX_PROFILES, max_bytes: int = MAX_BYTES,
               stage=None, only: str | None = None,
               measure: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each posting with each profile, the profile as a struct column ``profile``.

    ``size`` is the rows and bytes of the profiles, measured here if it is not given.
    ``only`` names a column with the ids of the profiles that a posting is paired with.
    Where there are several blocks and a ``stage``, ``measure`` makes a struct of arrays that have
    an entry for each profile, which come as columns that begin with :data:`MEASURED`; it gets the
    profiles of a pass in a task's first row and null in the others.
    """
    rows, width = size or table_size(profiles)
    least = max(ceil(width / max_bytes), 1)
    blocks = max(ceil(rows / max_profiles), least)
    together = max(1, min(MAX_PROFILES // max_profiles, blocks // least))
    packed = profiles.select(F.struct("*").alias("profile"))
    if blocks > 1:
        packed = packed.withColumn("_part", F.pmod(F.xxhash64("profile.profile_id"), F.lit(blocks)).cast("int"))
        if stage is not None:
            # Made once: each block then reads its own folder of profiles.
            postings, packed = stage(postings), stage(packed, by="_part")

    def measured(numbers: range) -> DataFrame:
        # Each block is read from its own folder.
        own = reduce(DataFrame.unionAll, [packed.where(F.col("_part") == number) for number in numbers])
        # Sorted, so that both uses have one order. Broadcast: a literal would go with every task of every block.
        block = own.agg(F.sort_array(F.collect_list("profile")).alias("_profiles"))
        first = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1) == 0
        sent = postings.crossJoin(F.broadcast(block)).withColumn("_profiles", F.when(first, F.col("_profiles")))
        made = sent.withColumn("_signals", measure(F.col("_profiles")))
        names = made.schema["_signals"].dataType.names
        # Numbers stay in their arrays until a pair's are taken: a struct for each pair would be copied twice.
        each = made.select(*postings.columns, "_signals", F.posexplode(F.col("_signals")[names[0]]).alias("_at", "_first"))
        taken = [F.get(F.col("_signals")[name], F.col("_at")).alias(MEASURED + name) for name in names]
        return each.select(*postings.columns, "_at", *taken).join(
            F.broadcast(block.select(F.posexplode("_profiles").alias("_at", "profile"))), "_at").drop("_at")

    def paired(number: int) -> DataFrame:
        own = packed if blocks == 1 else packed.where(F.col("_part") == number)
        gathered = own.agg(F.collect_list("profile").alias("profiles")).scalar()
        both = postings.select("*", F.explode(gathered).alias("profile"))
        return both.where(F.array_contains(F.col(only), F.col("profile.profile_id"))) if only else both

    if blocks > 1 and stage is not None and measure is not None:
        return reduce(DataFrame.unionAll, [
            measured(range(at, min(at + together, blocks))) for at in range(0, blocks, together)])
    return reduce(DataFrame.unionAll, map(paired, range(blocks)))


def keyed_pairs(postings: DataFrame, profiles: DataFrame, key: str, *,
                size: tuple[int, int] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Each posting with the profiles that share its ``key``."""
    packed = profiles.select(F.col(key), F.struct("*").alias("profile"))
    _, width = size or table_size(profiles)
    if width <= max_bytes:
        return postings.join(F.broadcast(packed), key)
    return salted_join(postings, packed, key, how="inner", spread_by="posting_id")
