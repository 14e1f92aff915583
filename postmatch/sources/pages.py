"""Read landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmatch.sources.postings import spread


def read_pages(spark: SparkSession, path: str, format: str = "parquet",
               key: str = "page_id", **options) -> DataFrame:
    """Pages with ``url`` and ``html``; a small input is spread over the cores."""
    return spread(spark.read.format(format).options(**options).load(path), key)
