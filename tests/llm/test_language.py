import math
import zlib
from collections import Counter

import numpy as np
import pytest

from postmatch.llm import common, eliasfano, language
from tests.llm import odd_tables as samples


@pytest.mark.parametrize("n, top", [(0, 10), (1, 0), (5, 2**64 - 1), (1000, 1000), (1000, 10**6), (70000, 10**12)])
def test_sequence(tmp_path, n, top):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True)) if n else np.zeros(0, np.uint64)
    eliasfano.save(str(tmp_path / "x"), *eliasfano.encoded(values, top))
    own = eliasfano.Sequence(*eliasfano.load(str(tmp_path / "x")))
    size = len(values)
    if size:
        assert (own.at(np.arange(size)) == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
    place = np.searchsorted(values, asked)
    there = (place < size) & (values[np.minimum(place, size - 1)] == asked) if size else np.zeros(len(asked), bool)
    assert (own.find(asked) == np.where(there, place, -1)).all()
    inside = own.find(asked, np.full(len(asked), 3), np.full(len(asked), 900))
    assert (inside == np.where(there & (place >= 3) & (place < 900), place, -1)).all()


def tokens(text):
    return [w.encode() for w in samples.split(samples.lower(text))] + [language.END]


def model(rows):
    counts, pairs = Counter(), Counter()
    for doc, text in rows:
        if doc is None or zlib.crc32(str(doc).encode()) % 10:
            own = tokens(text)
            counts.update(own)
            pairs.update(zip([language.END, *own], own))
    return counts, pairs


@pytest.mark.parametrize("width", [500, common.SLICE_BYTES])
def test_scores_match_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(common, "SLICE_BYTES", width)
    rows = [r[:2] for r in samples.rows(n=60)]
    counts, pairs = model(rows)
    total, size = sum(counts.values()), len(counts)
    got = language.scores(samples.documents(spark, n=60)).collect()
    want = []
    for doc, text in rows:
        own = tokens(text)
        want.append((doc, doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0, len(own),
                     sum(counts[t] > 0 for t in own), total,
                     round(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (size + 1))) for t in own), 6)))
    assert sorted(repr((*r[:5], round(r.base_score, 6))) for r in got) == sorted(map(repr, want))
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_every_context_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(language, "SPREAD", 16)
    docs = samples.documents(spark, n=60)
    model = language.build(docs)
    assert model.hot
    trie = language.Trie(model)
    size = model.starts[-1]
    for word in (b"na", b"kurz", b"never-seen", language.END):
        known = trie.words.number_of(word)
        mass = (10 ** trie.log_probs(np.full(size + 1, known), np.arange(size + 1))).sum()
        assert abs(mass - 1) < 0.03, word


@pytest.mark.parametrize("spread", [4, 16])  # with 16, some contexts are hot
def test_pair_probabilities_match_the_formula(spark, monkeypatch, spread):
    monkeypatch.setattr(language, "SPREAD", spread)
    rows = [r[:2] for r in samples.rows(n=60)]
    counts, pairs = model(rows)
    built = language.build(samples.documents(spark, n=60))
    starts, total, shards = built.starts, built.total, built.shards
    assert starts[-1] == len(counts) and total == sum(counts.values())
    trie = language.Trie(built)
    names = list(counts)
    number = {w: trie.words.number_of(w) for w in names}
    assert sorted(number[w] for w in names) == list(range(len(names)))
    followers = Counter(u for u, _ in pairs)
    asked = list(pairs)[:400]
    logs = trie.log_probs(np.array([number[u] for u, _ in asked]), np.array([number[w] for _, w in asked]))
    single = language.level_one(np.array([counts[w] for _, w in asked]), trie.words)
    hot = dict(zip(built.hot, built.hot_rest))
    assert {w for w in names if counts[w] * shards > total} == {w for w in names if number[w] in hot}
    for (u, w), one, got in zip(asked, single, logs):
        d = language.PAIR_DISCOUNT
        rest = hot.get(number[u], d * followers[u] / counts[u])
        p = (pairs[u, w] - d) / counts[u] + rest * one
        assert abs(math.log10(p) - got) <= 0.5 * 10 / 255 + 1e-9


def plain_score(text, counts, pairs, followers):
    total, size, d, score = sum(counts.values()), len(counts), language.PAIR_DISCOUNT, 0.0
    own = tokens(text)
    for u, w in zip([language.END, *own], own):
        one = max(counts[w] - 0.5, 0) / total + 0.5 * size / total / (size + 1)
        p = d * followers[u] / counts[u] * one if counts[u] else one
        if (u, w) in pairs:
            step = round(math.log10((pairs[u, w] - d) / counts[u]) / language.LEAST * language.STEPS)
            p += 10 ** (min(max(step, 0), language.STEPS) * language.LEAST / language.STEPS)
        score += math.log10(p)
    return score


def test_scores_match_the_formula_under_any_number_of_partitions(spark):
    rows = [r[:2] for r in samples.rows(n=60)]
    counts, pairs = model(rows)
    followers = Counter(u for u, _ in pairs)
    want = sorted((repr(doc), round(plain_score(text, counts, pairs, followers), 5)) for doc, text in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = language.scores(samples.documents(spark, n=60)).collect()
            found = sorted((repr(r.doc_id), round(r.score, 5)) for r in got)
            assert [x for x, _ in found] == [x for x, _ in want]
            assert max(abs(a - b) for (_, a), (_, b) in zip(found, want)) < 1e-4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_training_rows(spark):
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    row = language.scores(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert language.scores(samples.empty(spark)).count() == 0
