"""Text and failure status out of landed JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch.functions.text import strip


def json_text(payload: Column, path: str = "$.description.text") -> Column:
    """The text at a path, stripped; absent or broken payloads give the empty string."""
    return strip(F.coalesce(F.get_json_object(payload, path), F.lit("")))


def json_error(payload: Column) -> Column:
    """The payload's error message, or null when it reports none."""
    return F.nullif(F.get_json_object(payload, "$.error"), F.lit(""))


def json_status(payload: Column) -> Column:
    """HTTP status named by an error such as ``HTTP 429``, or null."""
    digits = F.regexp_extract(json_error(payload), r"^HTTP (\d{3})$", 1)
    return F.nullif(digits, F.lit("")).cast("int")
