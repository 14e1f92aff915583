"""The daily run: score, rank and report new posting files as they land.

The query remembers the files it has read and, in its state, the ids it has scored, so a
run reads the new files only: what it costs does not grow with what earlier runs wrote.
A posting that lands again, in the same batch or a later one, counts where it came first.
The state is kept by RocksDB, on disk and in the checkpoint, and holds one id and no
text per posting.

A batch's new postings are written once and scored, ranked and reported from there, so
all of them see the same rows. A batch that runs again starts from the same state and
overwrites its own folders, so it changes nothing.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postmatch.options import MatchOptions
from postmatch.plans.batch import scored_rows, selected, top_rows
from postmatch.sinks.report import write_reports
from postmatch.sinks.tables import staging, write_scored
from postmatch.sources.postings import POSTING_SCHEMA, conform, placed, spread

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for as long as a query takes to start; it keeps what it saw."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def first_seen(postings: DataFrame, retention: str | None = None) -> DataFrame:
    """A stream of postings without those whose id came before.

    Ids are remembered for good, or for ``retention`` (such as ``"90 days"``) after they
    first came: an id that lands later than that counts anew. Time is that of the batch,
    not of the rows, so that no row is ever too late.
    """
    if retention is None:
        return postings.dropDuplicates(["posting_id"])
    timed = postings.withColumn("_seen_at", F.current_timestamp()).withWatermark("_seen_at", retention)
    return timed.dropDuplicatesWithinWatermark(["posting_id"]).drop("_seen_at")


def score_new_files(spark: SparkSession, source: str, profiles: DataFrame, out_path: str,
                    checkpoint: str, options: MatchOptions | None = None, *,
                    format: str = "parquet", schema: T.StructType = POSTING_SCHEMA,
                    encoder=None, max_files: int | None = None, top_path: str | None = None,
                    report_path: str | None = None, retention: str | None = None,
                    staging_path: str | None = None) -> StreamingQuery:
    """Start a run over everything new in ``source``; it ends when that is done.

    ``out_path`` gets the thin scored rows of each batch, ``top_path`` its best rows per
    profile and ``report_path`` their pages. ``retention`` is how long an id is
    remembered, for good if it is not given. New postings are staged below
    ``staging_path``, by default beside the checkpoint, and removed with their batch.
    """
    options = options or MatchOptions()
    reader = spark.readStream.format(format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    counted = profiles.count()

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        own = f"batch_id={batch_id}"
        with staging(batch.sparkSession, staging_path or f"{checkpoint.rstrip('/')}-staging") as stage:
            fresh = stage(batch)
            write_scored(scored_rows(spread(fresh), profiles, options, encoder), f"{out_path}/{own}")
            if top_path or report_path:
                written = spark.read.parquet(f"{out_path}/{own}")
                top = top_rows(written, placed(fresh), options.top_matches, counted)
                if top_path:
                    top.write.mode("overwrite").parquet(f"{top_path}/{own}")
                    top = spark.read.parquet(f"{top_path}/{own}")
                if report_path:
                    write_reports(top, f"{report_path}/{own}", options.top_matches)

    new = first_seen(selected(conform(reader.load(source)), options), retention)
    with setting(spark, PROVIDER, ROCKS):
        return (
            new.writeStream.foreachBatch(score_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def scored_so_far(spark: SparkSession, out_path: str) -> DataFrame:
    """All batches as one table, with their ``batch_id``."""
    return spark.read.parquet(out_path)
