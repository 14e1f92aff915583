"""Skill sets of postings and profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.functions.arrays import bind, quoted
from postmatch.functions.numbers import percentage
from postmatch.functions.text import contained_terms
from postmatch.operators.vocabulary import as_tokens
from postmatch.options import MatchOptions


def skills_in(text: Column, options: MatchOptions) -> Column:
    """Vocabulary skills found in normalised text, sorted.

    A skill is found as a substring or, in token mode, where its tokens follow each other
    whole. The vocabulary is a literal, so this stays inside the scan's stage;
    :mod:`postmatch.operators.vocabulary` finds the terms of a large one.
    """
    if options.match_mode == "substring":
        return contained_terms(text, options.skill_list())
    sought = {name: f" {' '.join(re.findall(fixed.TOKEN_PATTERN, name))} " for name in options.skill_list()}
    pairs = ", ".join(f"struct({quoted(name)} AS name, {quoted(words)} AS words)"
                      for name, words in sought.items() if words.strip())
    if not pairs:
        return F.array().cast("array<string>")
    return bind(
        "b", f"transform(filter(array({pairs}), s -> contains(b.text, s.words)), s -> s.name)",
        text=F.coalesce(as_tokens(text), F.lit("")))


def matched_skills(posting: Column, profile: Column) -> Column:
    return F.array_sort(F.array_intersect(posting, profile))


def missing_skills(posting: Column, profile: Column) -> Column:
    return F.array_sort(F.array_except(posting, profile))


def shown_missing(missing: Column, options: MatchOptions) -> Column:
    return F.slice(missing, 1, options.shown_missing)


def skill_match(matched: Column, posting: Column) -> Column:
    """Share of the posting's skills that the profile has; no skills gives 0."""
    return percentage(F.size(matched), F.size(posting))
