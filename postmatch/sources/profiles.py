"""Assemble one text per profile from ordered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.text import strip

PARTS_PER_CHUNK = 1024
EMPTY_PROFILE = "no readable text in profile"


def _joined(order: Column, text: Column) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(order.alias("at"), text.alias("text"))))
    return F.array_join(F.transform(parts, lambda part: part["text"]), "\n")


def assemble(parts: DataFrame, *, profile: str = "profile_id", part: str = "part_no",
             text: str = "text") -> DataFrame:
    """``profile_id, text``: parts in order, joined by line feeds and stripped.

    Parts are first joined in runs of part numbers, so a profile with very many
    parts is sorted and joined by many tasks before its last, short join.
    """
    chunks = parts.groupBy(
        F.col(profile).alias("profile_id"),
        F.floor(F.col(part) / PARTS_PER_CHUNK).alias("_chunk"),
    ).agg(_joined(F.col(part), F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    return chunks.groupBy("profile_id").agg(
        strip(_joined(F.col("_chunk"), F.col("_text"))).alias("text")
    )


def readable(profiles: DataFrame) -> DataFrame:
    """Fail the run when a profile has no text.

    The check is a filter: it runs whichever columns are read later.
    """
    message = F.concat(F.lit(f"{EMPTY_PROFILE} "), F.col("profile_id").cast("string"))
    stop = F.raise_error(message).cast("boolean")
    return profiles.where(F.when(F.col("text") != "", F.lit(True)).otherwise(stop))


def split_unreadable(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles with text, and the ids of those without."""
    return (
        profiles.where(F.col("text") != ""),
        profiles.where(F.col("text") == "").select("profile_id"),
    )
