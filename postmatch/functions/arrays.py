"""Array expressions whose lambdas are written as SQL text.

One text costs one call into the JVM where the same lambda built from Python
columns costs one per node. :func:`bind` also keeps a costly input from being
evaluated once per element: the optimizer may move a column's expression to where
the column is used, and inside a lambda that is a loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strings(values) -> str:
    """SQL array literal of strings."""
    items = ", ".join(quoted(value) for value in values)
    return f"CAST(array({items}) AS array<string>)"


def in_list(values) -> str:
    """SQL value list for ``IN``; an empty list matches only the empty string."""
    return ", ".join(quoted(value) for value in values) or "''"


def quoted(value: str) -> str:
    """SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def bind(name: str, body: str, **inputs: Column) -> Column:
    """Evaluate the inputs once and give ``body`` their values as ``name.<input>``."""
    packed = F.array(F.struct(*[value.alias(key) for key, value in inputs.items()]))
    return F.get(F.call_function("transform", packed, F.expr(f"{name} -> {body}")), F.lit(0))


def keep(items: Column, condition: str) -> Column:
    """Elements for which a lambda such as ``x -> length(x) > 2`` holds."""
    return F.call_function("filter", items, F.expr(condition))


def each(items: Column, body: str) -> Column:
    return F.call_function("transform", items, F.expr(body))


def fold(items: Column, start: str, step: str) -> Column:
    return F.call_function("aggregate", items, F.expr(start), F.expr(step))
