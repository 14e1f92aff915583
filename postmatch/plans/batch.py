"""The batch run: read, select, assemble, score, write, rank, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.operators.rank import top_per_profile
from postmatch.operators.score import SCORE_COLUMNS, score_postings
from postmatch.options import MatchOptions
from postmatch.sinks.report import write_reports
from postmatch.sinks.tables import staging, with_postings, write_display, write_scored
from postmatch.sources.postings import read_postings
from postmatch.sources.profiles import assemble, readable, split_unreadable
from postmatch.sources.search import matches_search, posted_recently

THIN = ("posting_id", "profile_id", "job_title", "job_link")
#: Ranked rows that are sent to every task, at most; a row has some 500 bytes.
MOST_RANKED = 50_000


def selected(postings: DataFrame, options: MatchOptions) -> DataFrame:
    """The postings that the run's search asks for.

    A keyword, a place and a time each narrow only where they are set; a place needs a
    column ``location`` and a time a column ``posted_at``.
    """
    if options.as_of is not None:
        postings = postings.where(
            posted_recently(F.col("posted_at"), options.as_of, options.recency_seconds))
    if options.keyword or options.location:
        place = F.col("location") if options.location else F.lit("")
        postings = postings.where(matches_search(
            F.col("job_title"), F.col("job_description"), place,
            keyword=options.keyword, place=options.location))
    return postings


def scored_rows(postings: DataFrame, profiles: DataFrame, options: MatchOptions,
                encoder=None, key: str | None = None, stage=None) -> DataFrame:
    """One thin row per pair: ids, title, link and scores. Texts stay where they are."""
    scored = score_postings(postings, profiles, options, encoder, key, stage)
    return scored.select(*THIN, *scored.columns[scored.columns.index(SCORE_COLUMNS[0]):])


def top_rows(scored: DataFrame, postings: DataFrame, k: int, profiles: int | None = None) -> DataFrame:
    """The best ``k`` of every profile with their rank and all raw columns.

    The number of ``profiles`` bounds the ranked rows. Within :data:`MOST_RANKED` they
    travel to the postings, beyond it both sides are joined by id.
    """
    few = profiles is not None and profiles * k <= MOST_RANKED
    return with_postings(top_per_profile(scored, k), postings, few=few)


def run_match(spark: SparkSession, postings_path: str, profile_parts: DataFrame,
              out_path: str, options: MatchOptions | None = None, *,
              format: str = "parquet", encoder=None, key: str | None = None,
              report_path: str | None = None, display_path: str | None = None,
              display_format: str = "csv", ordered: bool = False,
              unreadable_path: str | None = None, staging_path: str | None = None,
              **reading) -> DataFrame:
    """Score a posting table against profiles; the best rows of every profile.

    The scored table is written once, thin, to ``out_path``; with ``ordered`` it is
    staged and sorted on the way. Ranking, reports and the display table are made from
    what was written, and raw columns are joined back to the rows that show them. The
    input is never overwritten and no staged copy is left.

    ``key`` pairs a posting only with the profiles that share this column, which
    ``profile_parts`` then has too. Profiles without text stop the run; with
    ``unreadable_path`` their ids are written there and the others go on.
    """
    options = options or MatchOptions()
    def postings(to_score: bool) -> DataFrame:
        return selected(read_postings(spark, postings_path, format, to_score=to_score, **reading), options)

    profiles = assemble(profile_parts)
    if unreadable_path:
        profiles, empty = split_unreadable(profiles)
        empty.write.mode("overwrite").parquet(unreadable_path)
    else:
        profiles = readable(profiles)
    if key:
        profiles = profiles.join(
            profile_parts.select("profile_id", key).distinct(), "profile_id")
    with staging(spark, staging_path) as stage:
        scored = scored_rows(postings(to_score=True), profiles, options, encoder, key, stage)
        write_scored(stage(scored) if ordered else scored, out_path, ordered=ordered)
    written = spark.read.parquet(out_path)
    raw = postings(to_score=False)
    if display_path:
        write_display(written, raw, display_path, display_format, ordered=ordered)
    top = top_rows(written, raw, options.top_matches, profiles.count())
    if report_path:
        write_reports(top, report_path, options.top_matches)
    return top
