"""Settings of a match run. Values reach Spark only as literals."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml.feature import StopWordsRemover

from postmatch import fixed


@dataclass(frozen=True)
class MatchOptions:
    """Everything a run can vary; the defaults give the documented scores.

    ``stop_words=None`` takes Spark's own English list. ``keyword``, ``location`` and
    ``as_of`` select a run's postings where they are set; ``card_cap`` limits the cards
    that are read from a page. ``match_mode`` tells where a skill is found: as a
    ``"substring"`` anywhere, or as whole ``"token"`` s. ``flag_semantic_errors`` adds a
    column that tells texts no vector was made of from texts that are unlike.
    """

    skills: tuple[str, ...] = fixed.SKILLS
    education_terms: tuple[str, ...] = fixed.EDUCATION_TERMS
    stop_words: tuple[str, ...] | None = None
    weights: Mapping[str, float] = field(default_factory=lambda: dict(fixed.WEIGHTS))
    top_keywords: int = 25
    shown_missing: int = 12
    experience_years: float = 0.0
    top_matches: int = 10
    card_cap: int | None = None
    recency_seconds: int = 86_400
    keyword: str = ""
    location: str = ""
    as_of: datetime | None = None
    match_mode: str = "substring"
    flag_semantic_errors: bool = False

    def __post_init__(self):
        if self.match_mode not in ("substring", "token"):
            raise ValueError(f"match_mode is 'substring' or 'token', not {self.match_mode!r}")

    def stop_list(self) -> list[str]:
        if self.stop_words is None:
            return StopWordsRemover.loadDefaultStopWords("english")
        return list(self.stop_words)

    def skill_list(self) -> list[str]:
        return sorted(set(self.skills))

    def education_list(self) -> list[str]:
        return sorted(set(self.education_terms))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides) -> "MatchOptions":
        """Read the search target and the years override from the environment."""
        env = os.environ if env is None else env
        values = {
            "keyword": env.get("JOB_TITLE_TARGET", ""),
            "location": env.get("JOB_LOCATION_TARGET", ""),
            "experience_years": float(env.get("USER_EXPERIENCE_YEARS") or 0.0),
        }
        return cls(**{**values, **overrides})
