import random

from pyspark.sql import functions as F

from postmatch.llm import decontaminate
from tests.llm import odd_tables as samples


def plain_shingles(text):
    words = samples.split(samples.lower(text))
    return {" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(docs, items):
    out = []
    for doc, text in docs:
        held = plain_shingles(text)
        for item, asked in set(items):
            parts = plain_shingles(asked)
            if parts and 5 * len(parts & held) >= 4 * len(parts):
                out.append((doc, item, len(parts), len(parts & held)))
    return sorted(map(repr, out))


def tables(spark):
    rng = random.Random(6)
    items = [(k, samples.prose(rng, rng.randint(6, 60))) for k in range(30)]
    items += [(30, "zwei WORTE"), (31, ""), (32, None), (None, samples.prose(rng, 12)), items[0], (33, "Kurz")]
    docs = [r[:2] for r in samples.rows()]
    for k, (_, text) in enumerate(items[:30]):
        words = text.upper().split() if k % 3 == 0 else text.split()
        for spoilt in range(k % 4):  # some copies fall below the limit
            words[(7 * spoilt + 3) % len(words)] = "spoilt"
        docs.append((5000 + k, f"{samples.prose(rng, 40 * k)} {' '.join(words)} {samples.prose(rng, 30)}"))
    docs.append((6000, items[1][1] + " " + items[4][1]))
    docs.append(docs[-1])
    return docs, items, (
        spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id bigint, text string, key string, q int").repartition(3),
        spark.createDataFrame([(*i, "h") for i in items], "item_id bigint, text string, sketch string"))


def test_pairs_match_brute_force(spark, monkeypatch):
    docs, items, frames = tables(spark)
    want = plain(docs, items)
    columns = ["doc_id", "item_id", "n_shingles", "n_matched"]
    got = decontaminate.find_leaks(*frames)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == want
    assert len(want) > 20
    monkeypatch.setattr(decontaminate, "KEYS_AT_ONCE", 7)  # many blocks, and no broadcast of items
    got = decontaminate.find_leaks(*frames)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == want


def test_a_sketch_cannot_be_missed(spark):
    _, items, (_, frame) = tables(spark)
    for row in decontaminate.item_sketches(frame).collect():
        assert len(row.sketch) >= min(row.q, row.q - row.need + 1)


def test_leaks_go(spark):
    docs, items, (frame, asked) = tables(spark)
    kept = decontaminate.without_leaks(frame, asked)
    assert kept.columns == frame.columns
    bad = {x.split(",")[0][1:] for x in plain(docs, items)}
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(d) for d, _ in docs if repr(d) not in bad)


def test_empty_tables(spark):
    docs, items, (frame, asked) = tables(spark)
    assert decontaminate.find_leaks(frame.where("false"), asked).count() == 0
    assert decontaminate.find_leaks(frame, asked.where("false")).count() == 0
    assert decontaminate.without_leaks(frame, asked.where("false")).count() == len(docs)


def test_a_column_may_have_any_name(spark):
    docs, items, (frame, asked) = tables(spark)
    named = frame.withColumn("_leak_key", F.lit("own"))
    kept = decontaminate.without_leaks(named, asked)
    assert kept.columns == named.columns
    assert kept.where("_leak_key = 'own'").count() == decontaminate.without_leaks(frame, asked).count()
