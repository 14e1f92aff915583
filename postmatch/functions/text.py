"""Text scalars. Every function takes and returns a ``Column``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.functions.arrays import bind, in_list, keep, strings

# Whitespace as Unicode defines it, plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
# Runs that one space has to replace: all but a lone space, which most are.
_SPACES = rf"(?U) {_SPACE}+|[\s\x1c-\x1f&&[^ ]]{_SPACE}*"
_EDGES = f"(?U)^{_SPACE}+|{_SPACE}+$"


def squeeze(text: Column) -> Column:
    """Whitespace runs become one space and the ends are trimmed; case is kept."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " "))


def normalise(text: Column) -> Column:
    """Lower-case :func:`squeeze`; null gives the empty string."""
    return squeeze(F.lower(text))


def strip(text: Column) -> Column:
    """Cut whitespace of any kind from both ends."""
    return F.regexp_replace(text, _EDGES, "")


def tokens(text: Column) -> Column:
    """Word tokens of normalised text, left to right."""
    return F.regexp_extract_all(text, F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def content_words(text: Column, stop_words: Sequence[str]) -> Column:
    """:func:`content_tokens` of the :func:`tokens` of a text: shorter ones are not even listed."""
    return content_tokens(F.regexp_extract_all(text, F.lit(fixed.LONG_TOKEN_PATTERN), F.lit(0)), stop_words)


def content_tokens(words: Column, stop_words: Sequence[str]) -> Column:
    """Keep tokens longer than two characters that are not stop words."""
    return keep(words, f"w -> length(w) > 2 AND w NOT IN ({in_list(stop_words)})")


def flag(text: Column, default: bool = False) -> Column:
    """Parse a yes/no setting; null gives the default, unknown words give false."""
    return F.coalesce(F.lower(strip(text)).isin(list(fixed.TRUE_FLAGS)), F.lit(default))


def comma_list(items: Column) -> Column:
    return F.array_join(items, ", ")


def contained_terms(text: Column, terms: Sequence[str]) -> Column:
    """The given terms that occur anywhere in the text, in the given order."""
    return bind("b", f"filter({strings(terms)}, term -> contains(b.text, term))", text=text)


def escape_html(text: Column) -> Column:
    """Escape ``& < > " '``; the ampersand goes first."""
    for plain, safe in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text
