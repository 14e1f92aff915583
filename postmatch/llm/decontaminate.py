"""Benchmark items inside documents, by containment of word shingles.

An item is short and a document can be long, so a sketch of fixed size of the document
would lose the item. Here the sketch is the item's: its smallest shingle hashes (a
bottom-k MinHash sketch), as many as its size class needs. An item of ``q`` shingles
that is contained to 80 % misses at most ``q - ceil(0.8 q)`` of them, so one more than
the largest such number of its class cannot all be missing: a contained item always
shares a sketch hash with the document. Documents too small to hold an item of that
size are left out. Candidates are then verified on the shingles themselves.

An item of fewer than WIDTH words is one shingle of its own length, while longer texts
have shingles of WIDTH words only: such an item is found in texts that consist of just
its words, never inside a longer one.

Only SQL functions are used. Documents are read once for each block of sketches and
once to verify; what is shuffled is pairs, and the texts of the documents that are
joined with the candidates.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmatch.functions.arrays import bind
from postmatch.llm.common import free_name, lower_ascii, staged, thin, words

WIDTH = 5
PERCENT = 80
#: Most sketch hashes, and most shingles, that are broadcast at once.
KEYS_AT_ONCE = 500_000


def _over(text: Column, one: str) -> Column:
    """``one`` of every window of WIDTH words; a shorter text is one window."""
    whole, part = one.format("p.w"), one.format(f"slice(p.w, i, {WIDTH})")
    return bind(
        "p",
        f"CASE WHEN size(p.w) = 0 THEN filter(array({whole}), y -> false) "
        f"WHEN size(p.w) <= {WIDTH} THEN array({whole}) "
        f"ELSE transform(sequence(1, size(p.w) - {WIDTH - 1}), i -> {part}) END",
        w=words(lower_ascii(text)))


def shingle_hashes(text: Column) -> Column:
    return _over(text, "xxhash64({})")


def shingles(text: Column) -> Column:
    return _over(text, "array_join({}, ' ')")


def text_key(text: Column) -> Column:
    """Equal texts share their verdict, whatever their id."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def item_sketches(items: DataFrame) -> DataFrame:
    """One row per different item with a word: its shingles and its sketch."""
    rows = (
        thin(items, "item_id", "text").distinct()
        .withColumn("item_key", F.xxhash64("item_id", "text"))
        .withColumn("parts", F.array_distinct(shingles(F.col("text"))))
        .withColumn("hashes", F.array_sort(F.array_distinct(shingle_hashes(F.col("text")))))
        .withColumn("q", F.size("parts"))
        .where("q > 0")
    )
    need = f"({PERCENT} * {{0}} + 99) div 100"
    largest = "(shiftleft(2, int(floor(log2(q)))) - 1)"
    return (
        rows.withColumn("need", F.expr(need.format("q")))
        .withColumn("k", F.expr(f"{largest} - {need.format(largest)} + 1"))
        .selectExpr("item_key", "item_id", "q", "need", "parts",
                    "slice(hashes, 1, int(k)) AS sketch")
    )


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``key, item_key`` of texts and items that share a sketch hash."""
    total = items.agg(F.sum(F.size("sketch"))).first()[0] or 0
    blocks = -(-total // KEYS_AT_ONCE) or 1
    windows = docs.select(
        text_key(F.col("text")).alias("key"), shingle_hashes(F.col("text")).alias("hashes")
    ).select("key", F.size("hashes").alias("n"), F.explode_outer("hashes").alias("h"))
    found = []
    for block in range(blocks):
        part = items.where(F.pmod("item_key", F.lit(blocks)) == block).select(
            "item_key", "need", F.explode("sketch").alias("h"))
        found.append(
            windows.join(F.broadcast(part), "h").where("n >= need").select("key", "item_key"))
    return functools.reduce(DataFrame.unionAll, found).distinct()


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, key, item_id, q, matched, containment`` where a document holds an item.

    A null text has no words and holds nothing; items without words are held by none.
    A null id is carried along, equal rows give equal rows, and either table may be
    empty.
    """
    docs = thin(docs, "doc_id", "text")
    items = staged(item_sketches(items), "items")
    pairs = staged(candidates(docs, items), "candidates")
    parts = items.select("item_key", "item_id", "q", "need", "parts")
    if (items.agg(F.sum("q")).first()[0] or 0) <= KEYS_AT_ONCE:
        parts = F.broadcast(parts)
    return (
        docs.withColumn("key", text_key(F.col("text")))
        .join(pairs, "key").join(parts, "item_key")
        .withColumn("matched", F.size(F.array_intersect(shingles(F.col("text")), "parts")))
        .where("matched >= need")
        .select("doc_id", "key", "item_id", F.col("q").cast("bigint").alias("n_shingles"),
                F.col("matched").cast("bigint").alias("n_matched"),
                (F.col("matched") / F.col("q")).alias("containment"))
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    own = free_name(docs, "_leak_key")
    leaked = staged(find_leaks(docs, items).select(F.col("key").alias(own)).distinct(), "leaked")
    kept = docs.join(leaked, text_key(F.col("text")) == F.col(own), "left_anti")
    return kept.select(*(F.col(f"`{n}`") for n in docs.columns))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
asked AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
held AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM split),
wanted AS (
  SELECT item_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM asked),
sizes AS (SELECT item_id, count(*) AS q FROM wanted GROUP BY item_id)
SELECT doc_id, item_id, q AS n_shingles, count(*) AS n_matched,
       count(*)::DOUBLE / q AS containment
FROM held JOIN wanted USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 80 * q
"""
