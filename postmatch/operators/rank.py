"""Order scored pairs and keep the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.operators.skew import top_per_group


def by_score(scored: DataFrame) -> DataFrame:
    """All pairs, best first; equal scores follow posting and profile id."""
    return scored.orderBy(F.desc("ats_score"), "posting_id", "profile_id")


def top_matches(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` pairs: a per-task top-k merged at the end, no full sort."""
    return by_score(scored).limit(k)


def top_per_profile(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` postings of every profile, with their ``rank``."""
    return top_per_group(
        scored,
        ["profile_id"],
        [F.desc("ats_score"), F.asc("posting_id")],
        k,
    )


def preview(top: DataFrame) -> DataFrame:
    """The three columns shown on screen after a run."""
    return top.select("job_title", "ats_score", "recommendation")
