import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from postmatch.llm import toxicity
from tests.llm import odd_tables as samples

STEMS = ("gruk", "vosch", "xulm")


def labelled(spark, n=600):
    rng = random.Random(9)
    vocabulary = [samples.word(rng) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        words = samples.prose(rng, rng.randint(8, 60), vocabulary).split()
        bad = k % 6 == 0
        for _ in range(rng.randint(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(STEMS) + samples.word(rng)
        docs.append((k, " ".join(words), "x", 0.5))
        labels.append((k, int(bad)))
    docs += [(n, None, "x", 0.5), (None, "gruka wort", "x", 0.5), (n + 1, "", "x", 0.5), (n + 2, "gruk" * 20000, "x", 0.5)]
    labels += [(None, 1), (n, None), (5, 0), (5, 0)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, word string, score double").repartition(3),
            spark.createDataFrame(labels, "doc_id bigint, toxic int"), docs)


def test_held_out_accuracy(spark):
    docs, labels, rows = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for doc, r in got.items():
        assert r.held_out == (doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(k % 6 == 0, got[k].predicted) for k in range(600) if got[k].held_out]
    assert np.mean([bad == bool(p) for bad, p in held]) > 0.95
    assert got[None].predicted == 1  # a new word of a known stem


def test_training_rows_are_bounded_and_never_held_out(spark):
    docs, labels, _ = labelled(spark)
    rows = toxicity.training_rows(docs.withColumn("text", F.col("doc_id").cast("string")), labels, 20).collect()
    assert len(rows) == 40 and sum(r.toxic for r in rows) == 20
    assert all(zlib.crc32(r.text.encode()) % 4 != 2 for r in rows)


def test_ratios_are_those_of_proper_distributions():
    counts = {}
    for kind, word, n in ((0, "bada", 5), (0, "bado", 3), (1, "gruk", 4), (1, "bada", 1), (0, "x", 2)):
        for part in toxicity.letter_windows(word):
            counts.setdefault(part, [0, 0])[kind] += n
    ratios = toxicity.Ratios.fitted({p: tuple(n) for p, n in counts.items()})
    assert ratios.word(b"gruk") > 1 > 0 > ratios.word(b"bado")
    assert abs(ratios.word(b"zzz")) < 1


def test_without_labels(spark):
    docs, labels, _ = labelled(spark, 12)
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_a_cut_class_keeps_its_share(spark):
    rng = random.Random(2)
    vocabulary = [samples.word(rng) for _ in range(300)]
    docs = spark.createDataFrame(
        [(k, samples.prose(rng, 20, vocabulary)) for k in range(1600)], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(1600)], "doc_id bigint, toxic int")
    # Texts tell nothing here, so a score can be no other than the toxic share of all labels.
    got = toxicity.toxicity(docs, labels, 160).where("held_out").collect()
    assert 0.06 < np.mean([r.score for r in got]) < 0.22
    assert np.mean([r.predicted for r in got]) < 0.1
