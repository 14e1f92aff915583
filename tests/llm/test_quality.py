import random

import zstandard

from postmatch.llm import quality
from tests.llm import odd_tables as samples


def plain(text):
    words = samples.split(text)
    lines = [x for x in (text or "").split("\n") if samples.split(x)]
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            sum(x in lines[:k] for k, x in enumerate(lines)), len(marked), failed)


def test_counts_match_brute_force(spark):
    rows = [r for r in samples.rows() if len(r[1] or "") < 5000]
    rows += [(2000, "x # y | <a>&\nzwei\n\n \nzwei\nx # y | <a>&\n" * 2, *[None] * 8)]
    got = quality.quality(spark.createDataFrame(rows, samples.SCHEMA)).collect()
    assert sorted(repr((r.doc_id, *r[1:7])) for r in got) == sorted(repr((r[0], *plain(r[1]))) for r in rows)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_bands():
    squeeze, bands, rng = zstandard.ZstdCompressor(level=3).compress, quality.Bands(), random.Random(1)
    vocabulary = [samples.word(rng) for _ in range(4000)]
    clean = samples.prose(rng, 3000, vocabulary).encode()
    assert quality.compression(clean, bands, squeeze)[2]
    assert not quality.compression(b"the same line again\n" * 400, bands, squeeze)[2]
    noise = bytes(rng.randrange(33, 127) for _ in range(20000))
    assert not quality.compression(noise, bands, squeeze)[2]
    half = clean[:6000] + bytes(rng.randrange(33, 127) for _ in range(20000))
    assert quality.compression(half, bands, squeeze)[1] > 0.5
    assert quality.compression(b"", bands, squeeze) == (1.0, 0.0, True)


def test_rejected_documents_go(spark):
    docs = samples.documents(spark)
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    want = sorted(repr(r.doc_id) for r in quality.quality(docs).where("kept").collect())
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want
    assert quality.quality(samples.empty(spark)).count() == 0


def test_bands_alone_reject_what_the_base_passes(spark):
    rng = random.Random(3)
    vocabulary = [samples.word(rng) for _ in range(4000)]
    prose = [samples.prose(rng, rng.randint(300, 340), vocabulary) for _ in range(240)]
    prose += [samples.prose(rng, 60, vocabulary)[:200] for _ in range(240)]
    long = [samples.prose(rng, 2200, vocabulary) for _ in range(30)]
    few = vocabulary[:12]
    repetitive = [" ".join(rng.choice(few) for _ in range(500))[:n] for n in (1600, 200)]
    noise = [" ".join("".join(chr(rng.randrange(33, 127)) for _ in range(5)) for _ in range(400))[:n] for n in (1600, 200)]
    odd = repetitive + noise
    texts = prose + long + odd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    first = len(prose) + len(long)
    assert all(got[k].kept for k in range(first))
    assert not any(got[k].base_failed for k in range(first, len(texts)))
    assert not any(got[k].kept for k in range(first, len(texts)))
    kept = {r.doc_id for r in quality.good_documents(docs).collect()}
    assert kept == {k for k, r in got.items() if r.kept}


def test_the_last_partial_chunk_counts():
    squeeze, bands, rng = zstandard.ZstdCompressor(level=3).compress, quality.Bands(), random.Random(1)
    clean = samples.prose(rng, 3000).encode()[:4096]
    noise = bytes(rng.randrange(33, 127) for _ in range(4000))
    share = quality.compression(clean + noise, bands, squeeze)[1]
    assert share == 4000 / 8096


def test_limits_follow_the_number_of_texts_without_a_step(spark):
    rng = random.Random(6)
    vocabulary = [samples.word(rng) for _ in range(4000)]
    prose = [samples.prose(rng, rng.randint(300, 340), vocabulary)[:1600] for _ in range(202)]
    noise = "".join(chr(rng.randrange(33, 127)) + " " * (k % 5 == 4) for k in range(1600))

    def limits(n):
        rows = list(enumerate([*prose[:n // 2], *prose[:n - n // 2]]))
        found = quality.measured(spark.createDataFrame(rows, "doc_id bigint, text string"))
        return quality.fitted_bands(found).limits(1600)

    below, above = limits(98), limits(102)
    assert all(abs(a - b) < 0.01 for a, b in zip(below, above))
    widths = [high - low for low, high in (limits(8), limits(40), limits(202))]
    assert widths == sorted(widths, reverse=True)
    docs = spark.createDataFrame(list(enumerate([*prose[:30], noise])), "doc_id bigint, text string")
    assert [r.doc_id for r in quality.quality(docs).where("NOT kept").collect()] == [30]
