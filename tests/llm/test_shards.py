import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from postmatch.llm import shards
from tests.llm import odd_tables as samples


def test_curve_visits_every_cell_by_steps_of_one():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n))).T
        place = shards.curve_numbers(list(cells), bits)
        assert sorted(place) == list(range(1 << bits * n))
        assert (np.abs(np.diff(cells[:, np.argsort(place)], axis=1)).sum(axis=0) == 1).all()


def test_rows_are_dealt_evenly_in_curve_order(spark):
    rows = samples.rows()
    got = shards.shard_rows(samples.documents(spark)).collect()
    want = sorted(repr((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()))) for r in rows)
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(40)]
    assert set(slots) <= set(range(40)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_shards_are_compact(spark):
    docs = spark.createDataFrame(
        [(k, "x" * (1 + k % 64), "abcd"[k // 64 % 4], f"s{k // 256}") for k in range(2048)],
        "doc_id bigint, text string, lang string, source string")
    got = docs.join(shards.sharded(docs), "doc_id").collect()
    spans = defaultdict(lambda: (set(), set()))
    for r in got:
        spans[r.shard][0].add(r.lang)
        spans[r.shard][1].add(r.source)
    assert np.mean([len(a) * len(b) for a, b in spans.values()]) < 32 / 3


def test_few_rows_and_none(spark):
    few = shards.shard_rows(samples.documents(spark).limit(3)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert shards.shard_rows(samples.empty(spark)).count() == 0


def test_one_cell_of_all_rows(spark):
    docs = spark.createDataFrame([(k, "same", None, None) for k in range(500)],
                                 "doc_id bigint, text string, lang string, source string").repartition(4)
    got = Counter(r.shard for r in shards.shard_rows(docs).collect())
    assert max(got.values()) - min(got.values()) <= 1


def test_written_shards(spark, tmp_path):
    docs = samples.documents(spark)
    shards.write_shards(docs, str(tmp_path / "out"), shards=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(c for c in back.columns if c != "shard") == sorted(docs.columns)
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 6


def plain_edges(values, bits=shards.BITS):
    ordered, parts = sorted(values, key=str.encode), 1 << bits
    return sorted({ordered[-(-k * len(ordered) // parts) - 1] for k in range(1, parts)}, key=str.encode) if ordered else []


def test_string_edges_match_brute_force(spark):
    rng = random.Random(5)
    for n, kinds in ((0, 1), (3, 9), (700, 5), (700, 300)):
        values = [f"https://example.org/{'z' * rng.randint(0, 2)}{rng.randrange(kinds) ** 2 // kinds}é" for _ in range(n)]
        rows = spark.createDataFrame([(v,) for v in values], "d string").repartition(3)
        assert shards.string_edges(rows, "d") == plain_edges(values)


def test_order_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, "x" * rng.randint(0, 90), rng.choice(["en", "de", None, ""]), f"dataset_of_web_pages_{rng.randrange(40)}")
            for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    shares = ", ".join(str(k / 32) for k in range(1, 32))
    size_edges = sorted(set(docs.selectExpr(f"percentile_approx(length(text) + 16L, array({shares}), 1000)").first()[0]))
    edges = [plain_edges([r[c] or "" for r in rows]) for c in (2, 3)]

    def place(row):
        cells = [sum(e < len(row[1]) + 16 for e in size_edges) * 32 // (len(size_edges) + 1)]
        cells += [sum(e.encode() < (row[c] or "").encode() for e in own) * 32 // (len(own) + 1) for c, own in zip((2, 3), edges)]
        number = shards.curve_numbers([np.array([c]) for c in cells])[0]
        return (int(number), zlib.crc32(row[1].encode()), row[0])

    got = [r.doc_id for r in shards.sharded(docs).orderBy("shard", "slot").collect()]
    assert got == [r[0] for r in sorted(rows, key=place)]
