"""Read posting tables under a fixed column contract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmatch import fixed

POSTING_SCHEMA = T.StructType(
    [
        T.StructField("posting_id", T.LongType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("job_title", T.StringType()),
        T.StructField("job_link", T.StringType()),
        T.StructField("job_description", T.StringType()),
    ]
)
REQUIRED = ("job_description",)
OPTIONAL_TEXT = ("job_title", "job_link")
#: Where a row lies: its file and its number there.
PLACE = "_place"


class MissingColumn(ValueError):
    """A posting table lacks a column it must have."""


def conform(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Apply the posting contract to a table.

    ``names`` maps our column names to the table's. Display headers such as
    ``Job Description`` are understood without it. The description must be there;
    a missing title or link becomes the empty string. Without an id a posting's id is
    a hash of its link, title and description, so equal postings share one.
    """
    renames = {**fixed.POSTING_HEADERS, **(names or {})}
    for ours, theirs in renames.items():
        if ours not in df.columns and theirs in df.columns:
            df = df.withColumnRenamed(theirs, ours)
    for name in REQUIRED:
        if name not in df.columns:
            header = renames.get(name, name)
            raise MissingColumn(f"posting table has no column {name!r} (or {header!r})")
    for name in OPTIONAL_TEXT:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    if "posting_id" not in df.columns:
        df = df.withColumn("posting_id", F.xxhash64("job_link", "job_title", "job_description"))
    return df


def spread(df: DataFrame, key: str = "posting_id") -> DataFrame:
    """Use every core on an input that would be read by fewer tasks than that.

    A small file arrives as one or two scan tasks, yet scoring is compute-bound.
    The planner's own estimate of the size tells how many tasks a scan will have;
    nothing runs for it. Inputs of enough tasks, as any large table is, are left where
    they are. Hashing a unique key keeps the split the same on a retry.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    per_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if cores > 1 and size // per_task < 2 * cores:
        return df.repartition(2 * cores, key)
    return df


def read_postings(spark: SparkSession, path: str, format: str = "parquet", *,
                  schema: T.StructType | None = None,
                  names: Mapping[str, str] | None = None, to_score: bool = True,
                  **options) -> DataFrame:
    """Read a posting table; a path that does not exist is Spark's own error.

    Text formats need their columns spelled out and default to
    :data:`POSTING_SCHEMA`; Parquet and ORC carry their own.

    Rows to score are spread over all cores. Rows to look up stay in their scan tasks, and
    Parquet's have their place as one more column :data:`PLACE`.
    """
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif format in ("csv", "json"):
        reader = reader.schema(POSTING_SCHEMA)
    loaded = reader.load(path)
    if to_score:
        return spread(conform(loaded, names))
    return conform(placed(loaded) if format == "parquet" else loaded, names)


def placed(df: DataFrame) -> DataFrame:
    """A table as Parquet files hold it, with the place of each row."""
    return df.withColumn(PLACE, F.struct("_metadata.file_path", "_metadata.row_index"))
