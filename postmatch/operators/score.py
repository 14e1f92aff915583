"""From texts to one explainable score per (profile, posting) pair."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.functions.numbers import bounded_percentage, nonzero, norm, sparse_norm
from postmatch.functions.text import comma_list, content_words, normalise
from postmatch.operators import features, keywords, skills
from postmatch.operators.measure import block_signals
from postmatch.operators.pairing import MAX_PROFILES, MEASURED, every_pair, keyed_pairs, table_size
from postmatch.operators.semantic import HashingEncoder, semantic_match
from postmatch.options import MatchOptions

SCORE_COLUMNS = (
    "ats_score", "semantic_match", "skill_match", "keyword_match", "title_match",
    "experience_match", "education_bonus", "matched_skills", "missing_skills",
    "recommendation",
)
_POSTING_FEATURES = (
    "_text", "_has_text", "_words", "_skills", "_keywords", "_weight", "_title_words", "_years",
    "_education", "_vector", "_norm",
)


#: Tables below this size are not worth starting Python workers for their keywords.
FEW_BYTES = 1 << 20


def _is_small(postings: DataFrame) -> bool:
    """Whether a table is small, by the planner's own estimate; nothing runs for it."""
    if postings.isStreaming:
        return False
    return int(postings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < FEW_BYTES


def posting_features(postings: DataFrame, options: MatchOptions, encoder) -> DataFrame:
    """Everything about a posting that no profile changes, once per posting."""
    read = postings.withColumn("_text", normalise(F.col("job_description")))
    found = read.withColumns(
        {
            "_has_text": F.col("_text") != "",
            "_words": content_words(F.col("_text"), options.stop_list()),
            "_skills": skills.skills_in(F.col("_text"), options),
            "_title_words": features.title_tokens(
                normalise(F.col("job_title")), options
            ),
            "_years": features.max_years(F.col("_text")),
            "_education": features.required_education(F.col("_text"), options),
        }
    )
    weighed = found.withColumn(
        "_keywords",
        keywords.weighted_keywords(
            F.col("_words"), F.col("_skills"), options.top_keywords, in_batches=not _is_small(postings)
        ),
    ).withColumn("_weight", keywords.total_weight(F.col("_keywords")))
    coded = encoder.encode(weighed, "_text", "_words", "_vector")
    return coded.withColumn("_norm", norm(F.col("_vector")))


def profile_features(profiles: DataFrame, options: MatchOptions, encoder,
                     key: str | None = None) -> DataFrame:
    """The profile side of every signal, once per profile."""
    read = profiles.withColumn("text", normalise(F.col("text"))).withColumn(
        "words", content_words(F.col("text"), options.stop_list())
    )
    coded = encoder.encode(read, "text", "words", "vector")
    return coded.withColumn("vector", nonzero(F.col("vector"))).select(
        "profile_id",
        *([key] if key else []),
        "text",
        skills.skills_in(F.col("text"), options).alias("skills"),
        features.profile_years(F.col("text"), options).alias("years"),
        "vector",
        sparse_norm(F.col("vector")).alias("norm"),
    )


def weighted_score(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted sum of the already rounded parts, itself bounded and rounded."""
    total = None
    for name in fixed.WEIGHTS:
        term = parts[name] * F.lit(float(weights[name]))
        total = term if total is None else total + term
    return bounded_percentage(total)


def recommendation(score: Column, missing: Column) -> Column:
    """Advice by score; low scores differ by whether any skill is missing."""
    advice = None
    for bound, text in fixed.RECOMMENDATIONS:
        step = advice.when if advice is not None else F.when
        advice = step(score >= bound, text)
    return advice.when(F.size(missing) > 0, fixed.LOW_WITH_MISSING).otherwise(
        fixed.LOW_WITHOUT_MISSING
    )


def score_pairs(pairs: DataFrame, options: MatchOptions) -> DataFrame:
    """Add the score columns to rows that hold posting features and a profile.

    Signals that were measured for a whole block of profiles are taken as they are.
    """
    profile = F.col("profile")
    has_text = F.col("_has_text")
    nothing = F.array().cast("array<string>")

    given = [c for c in pairs.columns if c.startswith(MEASURED)]

    def part(name: str, value: Column) -> Column:
        return F.col(MEASURED + name) if given else F.when(has_text, value).otherwise(0.0)

    signals = pairs.withColumns(
        {
            "profile_id": profile["profile_id"],
            "semantic_match": part(
                "semantic_match",
                semantic_match(
                    profile["text"] != "", profile["vector"], F.col("_vector"),
                    profile["norm"], F.col("_norm"),
                )
            ),
            "keyword_match": part(
                "keyword_match",
                keywords.keyword_match(profile["text"], F.col("_keywords"), F.col("_weight"))
            ),
            "title_match": part("title_match", features.title_match(profile["text"], F.col("_title_words"))),
            "experience_match": part(
                "experience_match",
                features.experience_match(F.col("_years"), profile["years"])
            ),
            "education_bonus": part(
                "education_bonus",
                features.education_bonus(profile["text"], F.col("_education"))
            ),
            "matched_skills": F.when(
                has_text, skills.matched_skills(F.col("_skills"), profile["skills"])
            ).otherwise(nothing),
            "_missing": F.when(
                has_text, skills.missing_skills(F.col("_skills"), profile["skills"])
            ).otherwise(nothing),
        }
    )
    rated = signals.withColumn(
        "skill_match",
        part("skill_match", skills.skill_match(F.col("matched_skills"), F.col("_skills"))),
    )
    scored = rated.withColumn(
        "ats_score",
        part(
            "ats_score",
            weighted_score({name: F.col(name) for name in fixed.WEIGHTS}, options.weights)
        ),
    )
    if options.flag_semantic_errors:
        # Two texts, but no vector of one of them: its 0 says nothing about the texts.
        scored = scored.withColumn("semantic_error", has_text & (profile["text"] != "") & (
            F.col("_vector").isNull() | profile["vector"].isNull()))
    return scored.withColumns(
        {
            "missing_skills": F.col("_missing"),
            "recommendation": F.when(
                has_text, recommendation(F.col("ats_score"), F.col("_missing"))
            ).otherwise(fixed.NO_DESCRIPTION),
        }
    ).drop("_missing", "profile", *given, *_POSTING_FEATURES)


def score_postings(postings: DataFrame, profiles: DataFrame,
                   options: MatchOptions | None = None, encoder=None,
                   key: str | None = None, stage=None,
                   max_profiles: int = MAX_PROFILES) -> DataFrame:
    """Score postings against profiles.

    ``profiles`` has ``profile_id, text`` (and ``key`` when pairing by key). The
    posting's own columns come back first, then ``profile_id`` and the scores.

    More than ``max_profiles`` profiles pass over the postings in blocks. ``stage``,
    a function that writes a table and reads it again, then keeps the postings'
    features from being computed for every block.
    """
    options = options or MatchOptions()
    encoder = encoder or HashingEncoder()
    left = posting_features(postings, options, encoder)
    size = table_size(profiles.select("profile_id", "text"))
    right = profile_features(profiles, options, encoder, key)
    if key:
        pairs = keyed_pairs(left, right, key, size=size)
    else:
        pairs = every_pair(left, right, size=size, max_profiles=max_profiles, stage=stage,
                           measure=lambda block: block_signals(options.weights, block))
    flags = ["semantic_error"] if options.flag_semantic_errors else []
    return score_pairs(pairs, options).select(
        *postings.columns, "profile_id", *SCORE_COLUMNS, *flags
    )


def report_columns(scored: DataFrame, options: MatchOptions | None = None) -> DataFrame:
    """All raw columns, then the scores; known ones under their display headers.

    Lists are joined and the missing skills cut to those shown. The education signal
    counts in the score but is not a display column.
    """
    options = options or MatchOptions()
    values = {
        "matched_skills": comma_list(F.col("matched_skills")),
        "missing_skills": comma_list(skills.shown_missing(F.col("missing_skills"), options)),
    }
    known = [n for n in fixed.POSTING_HEADERS if n in scored.columns]
    raw = [n for n in scored.columns if n not in (*known, *SCORE_COLUMNS)]
    ours = [n for n in fixed.SCORE_HEADERS if n in scored.columns]
    return scored.select(
        *[F.col(n).alias(fixed.POSTING_HEADERS[n]) for n in known],
        *raw,
        *[values.get(n, F.col(n)).alias(fixed.SCORE_HEADERS[n]) for n in ours],
    )
