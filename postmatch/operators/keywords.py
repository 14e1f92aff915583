"""Weighted keywords of one posting, computed inside its own row.

A posting's tokens never leave the row: they are sorted, counted by the gaps
between the starts of equal runs, and those seen more than once or boosted are ranked as
packed integers. There is no
explode, no grouping and no exchange, so the cost grows with the text alone and no
key can become hot. For whole tables the same is counted over Arrow batches of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch.functions.arrays import bind, each, fold
from postmatch.functions.numbers import percentage

SKILL_BOOST = 2
AFTER_TOKENS = 1 << 30
#: Tokens counted at once, about; a row is never split.
MOST_TOKENS = 1 << 20


def _runs(words: Column) -> Column:
    """``first position << 31 | count`` of every distinct token, in token order.

    Sorting tokens with their positions puts the first position of each token at
    the start of its run; the next start gives the run's length.
    """
    ordered = F.sort_array(each(words, "(w, i) -> struct(w, i AS at)"))
    starts = bind(
        "b",
        """struct(b.s, filter(sequence(0, size(b.s)), i -> i < size(b.s) AND
            (i = 0 OR get(b.s, i).w != get(b.s, i - 1).w)) AS start)""",
        s=ordered,
    )
    return bind(
        "b",
        """transform(b.r.start, (at, j) ->
            shiftleft(CAST(get(b.r.s, at).at AS BIGINT), 31)
            + coalesce(get(b.r.start, j + 1), size(b.r.s)) - at)""",
        r=starts,
    )


def term_counts(words: Column) -> Column:
    """``array<struct<token, n, first_pos>>`` of a token array, by token."""
    return bind(
        "b",
        """transform(b.runs, r -> struct(
            get(b.words, CAST(shiftright(r, 31) AS INT)) AS token,
            r & 2147483647L AS n, CAST(shiftright(r, 31) AS INT) AS first_pos))""",
        runs=_runs(words),
        words=words,
    )


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(words: pa.ListArray, skills: pa.ListArray, top: int | None) -> pa.ListArray:
    """The weighted keywords of some rows, as :func:`weighted_keywords` ranks them."""
    long, wide = _lengths(words), _lengths(skills)
    coded = pa.concat_arrays([words.flatten(), skills.flatten()]).dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.concatenate([np.repeat(np.arange(len(long)), long), np.repeat(np.arange(len(wide)), wide)])
    keys, total = rows * max(1, len(coded.dictionary)) + codes, int(long.sum())
    order = np.argsort(keys[:total], kind="stable")
    run = keys[order]
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    distinct, weights = run[starts], np.diff(starts, append=total)
    # Looked up by halving: numpy's own set functions would hash every distinct token.
    at = np.searchsorted(distinct, keys[total:])
    known = np.append(distinct, -1)[at] == keys[total:]
    boost = np.zeros(len(distinct), dtype=bool)
    boost[at[known]] = True
    weights[boost] += SKILL_BOOST
    # At the place of a token's first appearance its weight; skills that are not tokens follow.
    placed = np.zeros(len(keys), dtype=np.int64)
    placed[order[starts]] = weights
    placed[total:][~known & (long > 0)[rows[total:]]] = SKILL_BOOST
    kept = np.flatnonzero(placed)
    heaviest = int(placed.max(initial=0))
    kept = kept[np.argsort(rows[kept] * (heaviest + 1) + heaviest - placed[kept], kind="stable")]
    sizes = np.bincount(rows[kept], minlength=len(long))
    rank = np.arange(len(kept)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    if top is not None:
        kept, rank, sizes = kept[rank <= top], rank[rank <= top], np.minimum(sizes, top)
    listed = pa.StructArray.from_arrays(
        [coded.dictionary.take(pa.array(codes[kept])), pa.array(placed[kept]), pa.array(rank.astype(np.int32))],
        ["token", "weight", "rank"])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    none = ~(words.is_valid().to_numpy(zero_copy_only=False) & skills.is_valid().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(ends), listed, mask=pa.array(none))


def _in_batches(words: Column, skills: Column, top: int | None) -> Column:
    @F.arrow_udf("array<struct<token: string, weight: bigint, rank: int>>")
    def ranked(words: pa.Array, skills: pa.Array) -> pa.Array:
        ends, parts, at = np.cumsum(_lengths(words)), [], 0
        while at < len(words):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + MOST_TOKENS, "right")))
            parts.append(_counted(words.slice(at, stop - at), skills.slice(at, stop - at), top))
            at = stop
        return pa.concat_arrays(parts) if parts else _counted(words, skills, top)

    # Named twice, both stay columns of their own: Spark 4.1 leaves a Python function of some inlined lambdas unevaluated.
    return F.when((F.size(words) >= 0) & (F.size(skills) >= 0), ranked(words, skills))


def weighted_keywords(words: Column, skills: Column, top: int | None = None, *, in_batches: bool = False) -> Column:
    """``array<struct<token, weight, rank>>``: count plus a boost for skills.

    Heaviest first, equal weights in order of first appearance. Skills that are
    not tokens carry the boost alone and come after the tokens of that weight, by
    name. A posting without tokens has no keywords at all. ``top`` keeps the first
    so many.

    Most tokens of a text occur once and weigh 1. They come last, in their order, so only
    the others are counted and sorted with their positions. ``in_batches`` counts the tokens
    of many rows at once in Python workers, faster over whole tables; ``words`` and ``skills``
    then have to be columns of the table, not expressions over it.
    """
    if in_batches:
        return _in_batches(words, skills, top)
    # A token seen n times stands n - 1 times in ``more``, and once for each point of a boost.
    again = bind("s", "filter(s.words, (w, i) -> w = get(s.words, i + 1))", words=F.sort_array(words))
    sides = bind(
        "b",
        f"""struct(b.words, sort_array(concat(
                b.again, flatten(array_repeat(array_intersect(b.skills, b.words), {SKILL_BOOST})))) AS more,
            IF(size(b.words) = 0, filter(b.skills, s -> false),
               filter(b.skills, s -> NOT array_contains(b.words, s))) AS added)""",
        words=words,
        skills=skills,
        again=again,
    )
    once = "array_except(b.t.words, b.t.more)"
    if top is not None:
        once = f"""IF(size(array_distinct(b.t.more)) + size(b.t.added) >= {int(top)},
            filter(b.t.more, w -> false), slice({once}, 1, {int(top)}))"""
    placed = bind(
        "b",
        f"""struct(b.t.added, b.t.more, array_intersect(b.t.words, b.t.more) AS tokens, {once} AS once,
            filter(sequence(0, size(b.t.more)), i -> i < size(b.t.more)
                AND (i = 0 OR get(b.t.more, i) != get(b.t.more, i - 1))) AS start)""",
        t=sides,
    )
    # Tokens in the order of their runs, each with its turn by first appearance.
    turns = bind(
        "b", "struct(b.p, sort_array(transform(b.p.tokens, (w, i) -> struct(w, i AS at))) AS turn)", p=placed)
    keys = bind(
        "b",
        f"""struct(b.r.p.tokens, b.r.p.added, b.r.p.once, sort_array(concat(
            transform(b.r.p.start, (at, j) -> get(b.r.turn, j).at
                - shiftleft(CAST(coalesce(get(b.r.p.start, j + 1), size(b.r.p.more)) - at + 1 AS BIGINT), 31)),
            transform(b.r.p.added, (s, i) -> {AFTER_TOKENS}L + i - shiftleft({SKILL_BOOST}L, 31))
            )) AS keys)""",
        r=turns,
    )
    ranked = """concat(
            transform(b.k.keys, (key, i) -> struct(
                IF((key & 2147483647L) < %d,
                   get(b.k.tokens, CAST(key & 2147483647L AS INT)),
                   get(b.k.added, CAST((key & 2147483647L) - %d AS INT))) AS token,
                -shiftright(key, 31) AS weight, i + 1 AS rank)),
            transform(b.k.once, (w, i) -> struct(w AS token, 1L AS weight, size(b.k.keys) + i + 1 AS rank)))""" % (
        AFTER_TOKENS, AFTER_TOKENS)
    return bind("b", ranked if top is None else f"slice({ranked}, 1, {int(top)})", k=keys)


def total_weight(keywords: Column) -> Column:
    return fold(keywords, "0L", "(total, k) -> total + k.weight")


def keyword_match(profile_text: Column, keywords: Column, total: Column | None = None) -> Column:
    """Weight of the keywords the profile contains, as a share of all their weight."""
    total = total_weight(keywords) if total is None else total
    found = bind(
        "b",
        "filter(b.keywords, k -> contains(b.text, k.token))",
        keywords=keywords,
        text=profile_text,
    )
    return percentage(total_weight(found), total)
