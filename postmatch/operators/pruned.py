"""The best postings of every profile without scoring every pair.

Postings are sorted so that alike ones stand together and cut into blocks of BLOCK_ROWS.
A block's summary bounds what any of its postings can score with a profile: the part of
skills, title, years and education is exact for each kind of posting in the block, the
semantic part is bounded by the block's largest and smallest vector entries, and the
keyword part counts as full until the others are known posting by posting.

For every profile the blocks of the highest bounds are scored first, as many as hold k
postings. Their kth best score is the profile's threshold, and only blocks whose bound
reaches it are scored after that. What is left out cannot be among the best k, so the
result is that of scoring everything.

Bounds and scores are made for a block of profiles at once (:mod:`postmatch.operators.seekers`); which
of the postings' terms a profile's text holds is found once, by
:func:`postmatch.operators.vocabulary.terms_in` over the distinct words of all texts. Blocks of profiles travel one by one, postings stay
in their scan tasks, and a task returns at most k postings of a profile.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmatch.functions.arrays import bind, fold
from postmatch.functions.text import contained_terms
from postmatch.operators.measure import KIND
from postmatch.operators.pairing import MAX_BYTES, ROW_BITS, table_size
from postmatch.operators.rank import top_per_profile
from postmatch.operators.score import posting_features, profile_features
from postmatch.operators.seekers import best_blocks, best_pairs
from postmatch.operators.semantic import HashingEncoder
from postmatch.operators.skew import top_per_group
from postmatch.operators.vocabulary import terms_in
from postmatch.options import MatchOptions

#: Postings of a block, a power of two.
BLOCK_BITS = 5
BLOCK_ROWS = 1 << BLOCK_BITS
#: Profiles that meet postings at once, and blocks of them that are broadcast at the same time.
SEEKERS = 2048
AT_ONCE = 8
#: Sought terms of several words that are looked up one by one, at most.
FEW_SPACED = 64

_USED = ("posting_id", "_block", "_kind", *KIND, "_keywords", "_weight", "_vector", "_norm")


def in_blocks(found: DataFrame, stage) -> DataFrame:
    """Posting features with their ``_block``, alike postings in one block.

    What weighs most in a score sorts first, as text, so that sets which begin alike stand
    together. The key ends with the id, so no kind of posting is too frequent to be cut.
    """
    keys = {
        "_by_skills": F.array_join("_skills", ","), "_by_title": F.array_join("_title_words", ","),
        "_by_terms": F.array_join("_education", ","), "_by_vector": F.array_position("_vector", F.array_max("_vector")),
    }
    order = ("_has_text", "_by_skills", "_by_title", "_years", "_by_terms", "_by_vector", "posting_id")
    ranged = found.withColumns(keys).repartitionByRange(*order).sortWithinPartitions(*order).drop(*keys)
    # The id counts on within a task and leaps between tasks: no block spans two.
    return stage(ranged.withColumns({
        "_block": F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS), "_kind": F.to_json(F.struct(*KIND))}))


def summaries(placed: DataFrame) -> DataFrame:
    """One row per block: its kinds of postings and the bounds of its unit vectors."""
    unit = F.when(F.col("_norm") > 0, bind(
        "b", "transform(b.v, x -> try_divide(CAST(x AS DOUBLE), b.n))", v=F.col("_vector"), n=F.col("_norm")))
    grouped = placed.groupBy("_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.collect_set(F.struct("_kind", *KIND)).alias("_kinds"),
        F.collect_list(unit).alias("_vectors"))

    def extreme(pick: str) -> Column:
        return fold(F.col("_vectors"), "CAST(array() AS array<double>)",
                    f"(m, v) -> zip_with(m, v, (x, y) -> {pick}(coalesce(x, 0D), coalesce(y, 0D)))")

    return grouped.select("_block", "_rows", "_kinds", extreme("greatest").alias("_high"), extreme("least").alias("_low"))


def known_terms(right: DataFrame, sought: DataFrame, stage) -> DataFrame:
    """``_row, known``: the sought terms in each profile's text.

    A term without a space is in a text if it is in one of its words, so the terms are looked for
    in each distinct word of all texts once.
    """
    spaced = F.contains("term", F.lit(" "))
    words = right.select("_row", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    each = stage(words.select("word").distinct())
    inside = terms_in(each.select(F.col("word").alias("id"), F.col("word").alias("text")), sought.where(~spaced), stage=stage)
    parts = [words.join(stage(inside.groupBy(F.col("id").alias("word")).agg(F.collect_list("term").alias("terms"))), "word")]
    few = [r[0] for r in sought.where(spaced).limit(FEW_SPACED + 1).collect()]
    if len(few) > FEW_SPACED:
        found = terms_in(right.select(F.col("_row").alias("id"), "text"), sought.where(spaced), stage=stage)
        parts.append(found.select(F.col("id").alias("_row"), F.array("term").alias("terms")))
    elif few:
        parts.append(right.select("_row", contained_terms(F.col("text"), sorted(few)).alias("terms")))
    return reduce(DataFrame.unionAll, [p.select("_row", "terms") for p in parts]).groupBy("_row").agg(
        F.array_distinct(F.flatten(F.collect_list("terms"))).alias("known"))


def with_known_terms(right: DataFrame, placed: DataFrame, stage) -> DataFrame:
    """Profile features with ``known``, the postings' keywords, title words and education terms
    that are in a profile's text, and a number ``_row`` in place of the text."""
    right = stage(right.withColumn("_row", F.monotonically_increasing_id()))
    terms = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (
        F.col("_keywords.token"), F.col("_title_words"), F.col("_education"))])
    sought = stage(placed.select(F.explode(terms).alias("term")).distinct())
    known = known_terms(right, sought, stage)
    return right.join(known, "_row", "left").select(
        "_row", "profile_id", (F.col("text") != "").alias("has_text"), "skills", "years", "vector", "norm",
        F.coalesce("known", F.array().cast("array<string>")).alias("known"))


def scored_candidates(postings: DataFrame, profiles: DataFrame, options: MatchOptions | None = None,
                      k: int = 10, *, stage, encoder=None, max_profiles: int = SEEKERS) -> DataFrame:
    """``profile_id, posting_id, ats_score`` of every pair that may be among a profile's
    best ``k``. ``stage`` writes a table and reads it again."""
    options = options or MatchOptions()
    encoder = encoder or HashingEncoder()
    if min(options.weights.values()) < 0:
        raise ValueError("a part that lowers the score has no such bound")
    unused = [c for c in postings.columns if c != "posting_id"]
    found = stage(posting_features(postings, options, encoder).drop("_text", "_words", *unused))
    placed = in_blocks(found, stage)
    rows, width = table_size(profiles.select("profile_id", "text"))
    blocks = max(ceil(rows / max_profiles), ceil(width / MAX_BYTES), 1)
    part = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")
    right = stage(with_known_terms(profile_features(profiles, options, encoder), placed, stage).withColumn(
        "_part", part), by="_part")
    ids = {name: dict(df.dtypes)[name] for name, df in (("profile_id", profiles), ("posting_id", placed))}
    pair = f"_row long, profile_id {ids['profile_id']}, posting_id {ids['posting_id']}, ats_score double"

    def met(left: DataFrame, limits: DataFrame, task: Callable, schema: str, wanted: DataFrame | None = None) -> DataFrame:
        """What a task finds for each block of profiles, which go with their limits; a few blocks
        are broadcast and written, then the next, so that memory holds no more of them."""
        def one(number: int) -> DataFrame:
            own = right.where(F.col("_part") == number).join(limits, "_row", "left")
            sent = own.agg(F.collect_list(F.struct(*own.columns)).alias("_profiles"))
            rows = left if wanted is None else left.join(
                F.broadcast(wanted.where(part == number).select("_block").distinct()), "_block", "left_semi")
            begins = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1) == 0
            # Broadcast: a literal would go with every task. Only a task's first row keeps the profiles.
            return rows.crossJoin(F.broadcast(sent)).withColumn(
                "_profiles", F.when(begins, F.col("_profiles"))).mapInArrow(task, schema)

        parts = [one(number) for number in range(blocks)]
        return reduce(DataFrame.unionAll, [
            stage(reduce(DataFrame.unionAll, parts[at:at + AT_ONCE])) for at in range(0, blocks, AT_ONCE)])

    unlimited = right.select("_row", F.lit(None).cast("double").alias("_least"),
                             F.array().cast("array<bigint>").alias("_first"))
    limits = met(stage(summaries(placed)), unlimited, best_blocks(options.weights, k),
                 "_row long, _block long, _rows long, _bound double")
    best = top_per_group(limits, ["_row"], [F.desc("_bound"), F.asc("_block")], k, rank="_turn")
    before = Window.partitionBy("_row").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    first = stage(best.withColumn("_held", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(
        F.col("_held") < k).select("_row", "_block"))
    begun = first.groupBy("_row").agg(F.collect_list("_block").alias("_first"))
    left = placed.select(*_USED)
    began = met(left, begun.withColumn("_least", F.lit(None).cast("double")),
                best_pairs(options.weights, k, True), pair, first)
    reached = top_per_group(began, ["_row"], [F.desc("ats_score"), F.asc("posting_id")], k).groupBy("_row").agg(
        F.when(F.count(F.lit(1)) == k, F.min("ats_score")).alias("_least"))
    others = met(left, stage(begun.join(reached, "_row", "left")), best_pairs(options.weights, k, False), pair)
    return began.unionAll(others).select("profile_id", "posting_id", "ats_score")


def pruned_top(postings: DataFrame, profiles: DataFrame, options: MatchOptions | None = None,
               k: int = 10, **more) -> DataFrame:
    """The best ``k`` postings of every profile with their rank, as
    :func:`postmatch.operators.rank.top_per_profile` finds them among all pairs."""
    return top_per_profile(scored_candidates(postings, profiles, options, k, **more), k)
