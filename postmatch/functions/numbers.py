"""Percentages and vector arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch.functions.arrays import bind, each, fold, keep


def bounded_percentage(value: Column) -> Column:
    """Clamp to 0..100 and round to two digits, ties to even; null and NaN give 0.

    NaN has to go first: it would pass the clamp as 100.
    """
    number = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)) * 100) / 100


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, bounded; a zero or null whole gives 0."""
    return bounded_percentage(F.try_divide(part.cast("double"), whole.cast("double")) * 100)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, summed in double from left to right."""
    products = F.call_function(
        "zip_with", a, b, F.expr("(x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)")
    )
    return fold(products, "0D", "(total, x) -> total + x")


def nonzero(vector: Column) -> Column:
    """``array<struct<at, x>>``: the entries of a vector that are not zero, in order."""
    listed = each(vector, "(x, i) -> struct(i AS at, CAST(x AS DOUBLE) AS x)")
    return keep(listed, "e -> e.x IS NULL OR e.x != 0")


def sparse_dot(entries: Column, vector: Column) -> Column:
    """Dot product with the non-zero entries of one side: the same sum in the same
    order, since a zero adds nothing."""
    return bind(
        "b",
        "aggregate(b.e, 0D, (total, e) -> total + e.x * CAST(get(b.v, e.at) AS DOUBLE))",
        e=entries, v=vector)


def sparse_norm(entries: Column) -> Column:
    return F.sqrt(fold(entries, "0D", "(total, e) -> total + e.x * e.x"))


def norm(vector: Column) -> Column:
    squares = "(total, x) -> total + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)"
    return F.sqrt(fold(vector, "0D", squares))


def cosine_percentage(a: Column, b: Column, norm_a: Column | None = None,
                      norm_b: Column | None = None) -> Column:
    """Cosine as a bounded percentage: opposite directions and zero vectors give 0."""
    norm_a = norm(a) if norm_a is None else norm_a
    norm_b = norm(b) if norm_b is None else norm_b
    return bounded_percentage(F.try_divide(dot(a, b), norm_a * norm_b) * 100)
