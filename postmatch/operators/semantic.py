"""Text vectors and the semantic signal.

An encoder is any object with ``encode(df, text, words, out) -> DataFrame`` that
adds an ``array<float>`` column ``out``. A null vector scores 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.numbers import bounded_percentage, sparse_dot


@dataclass(frozen=True)
class HashingEncoder:
    """Term-frequency vector by feature hashing: no model, all on the JVM."""

    dimensions: int = 256

    def encode(self, df: DataFrame, text: str, words: str, out: str) -> DataFrame:
        hashed = HashingTF(
            inputCol=words, outputCol="_hashed_terms", numFeatures=self.dimensions
        ).transform(df)
        return hashed.withColumn(
            out, vector_to_array("_hashed_terms", "float32")
        ).drop("_hashed_terms")


@dataclass(frozen=True)
class StoredVectors:
    """Vectors computed elsewhere, already in a column of the table."""

    column: str

    def encode(self, df: DataFrame, text: str, words: str, out: str) -> DataFrame:
        if self.column not in df.columns:
            return df.withColumn(out, F.lit(None).cast("array<float>"))
        return df.withColumn(out, F.col(self.column).cast("array<float>"))


@dataclass(frozen=True)
class ModelEncoder:
    """A model behind an iterator pandas UDF.

    ``load`` runs once per Python worker and returns a function from a list of
    texts to a list of vectors. Texts it refuses get a null vector.
    """

    load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]

    def encode(self, df: DataFrame, text: str, words: str, out: str) -> DataFrame:
        load = self.load

        def one_by_one(model, texts):
            for item in texts:
                try:
                    yield np.asarray(model([item])[0], dtype="float32")
                except (ValueError, RuntimeError):
                    yield None

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                try:
                    rows = [np.asarray(v, dtype="float32") for v in model(texts.tolist())]
                except (ValueError, RuntimeError):
                    rows = list(one_by_one(model, texts))
                yield pd.Series(rows, dtype="object")

        return df.withColumn(out, vectors(F.col(text)))


def semantic_match(both_have_text: Column, profile_entries: Column, posting_vector: Column,
                   profile_norm: Column, posting_norm: Column) -> Column:
    """Cosine percentage of two texts' vectors, the profile's by its non-zero entries;
    an empty text gives 0."""
    cosine = F.try_divide(
        sparse_dot(profile_entries, posting_vector), profile_norm * posting_norm) * 100
    return F.when(both_have_text, bounded_percentage(cosine)).otherwise(0.0)
