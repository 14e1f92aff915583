"""One query per operator, over its whole table with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmatch.llm import (
    chat,
    decontaminate,
    language,
    negatives,
    pages,
    periodic,
    pieces,
    pii,
    quality,
    shards,
    simhash,
    substrings,
    toxicity,
)

#: The file of the merge-type model, found by the tokenizer package where it is installed.
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), piece_model())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.scores(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.whole_rows(table(spark, sf_dir, "embeddings"), relabel=7))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_main_text": op4_main_text,
    "op5_shards": op5_shards,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_substrings": op8_substrings,
    "op9_decontamination": op9_decontamination,
    "op10_language_model": op10_language_model,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_formatting": op13_chat_formatting,
}

ORACLES: dict[str, str] = {
    "op9_decontamination": decontaminate.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_chat_formatting": chat.ORACLE,
}
