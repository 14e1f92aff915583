"""Title, experience and education signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.functions.arrays import bind
from postmatch.functions.numbers import bounded_percentage, percentage
from postmatch.functions.text import contained_terms, content_tokens, tokens
from postmatch.options import MatchOptions


def found_in(text: Column, terms: Column) -> Column:
    """The elements of an array column that are substrings of the text."""
    return bind("b", "filter(b.terms, t -> contains(b.text, t))", terms=terms, text=text)


def title_tokens(title: Column, options: MatchOptions) -> Column:
    """Distinct content tokens of a normalised title."""
    return F.array_distinct(content_tokens(tokens(title), options.stop_list()))


def title_match(profile_text: Column, title_words: Column) -> Column:
    return percentage(F.size(found_in(profile_text, title_words)), F.size(title_words))


def max_years(text: Column) -> Column:
    """Greatest number of years named in normalised text, or null."""
    found = F.regexp_extract_all(text, F.lit(fixed.YEARS_PATTERN), F.lit(1))
    return F.array_max(found.cast("array<double>"))


def experience_match(required: Column, profile_years: Column) -> Column:
    """Full marks when nothing is asked or enough is offered, else the share of it."""
    return (
        F.when(required.isNull(), 100.0)
        .when(profile_years.isNull(), 0.0)
        .when(profile_years >= required, 100.0)
        .otherwise(bounded_percentage(F.try_divide(profile_years, required) * 100))
    )


def profile_years(text: Column, options: MatchOptions) -> Column:
    """The configured years when positive, else what the profile text says."""
    if options.experience_years > 0:
        return F.lit(float(options.experience_years))
    return max_years(text)


def required_education(text: Column, options: MatchOptions) -> Column:
    return contained_terms(text, options.education_list())


def education_bonus(profile_text: Column, required: Column) -> Column:
    """Share of the required terms the profile names; nothing required gives 100."""
    return F.when(F.size(required) == 0, 100.0).otherwise(
        percentage(F.size(found_in(profile_text, required)), F.size(required))
    )
