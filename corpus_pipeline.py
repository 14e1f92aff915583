"""From raw documents to a coded corpus: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmatch.llm import decontaminate, pieces, pii, quality, simhash
from postmatch.llm.common import staged
from postmatch.llm.queries import piece_model, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id."""
    return simhash.one_of_each(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as ids of the piece model, with digests of the ids and decoded text."""
    return pieces.encode_digests(docs, piece_model(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_copies),
    ("benchmark decontamination", benchmark_items),
    ("personal data", personal_data),
    ("piece coding", coded),
]

#: Compression and piece coding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
