import hashlib
import random

import numpy as np
import pytest

from postmatch.llm import substrings
from tests.llm import odd_tables as samples


def plain(rows):
    first = {}
    for doc, text in rows:
        words = samples.split(text)
        for k in range(len(words) - 49 if doc is not None else 0):
            gram = tuple(words[k:k + 50])
            first[gram] = min(doc, first.get(gram, doc))
    out = []
    for doc, text in rows:
        words = samples.split(text)
        gone = set()
        for k in range(len(words) - 49 if doc is not None else 0):
            if first[tuple(words[k:k + 50])] < doc:
                gone.update(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("slab", [200, substrings.SLAB])
def test_documents_match_brute_force(spark, monkeypatch, slab):
    monkeypatch.setattr(substrings, "SLAB", slab)
    rows = samples.rows()
    rng = random.Random(8)
    passage = samples.prose(rng, 130)
    rows += [(3000 + k, f"{samples.prose(rng, k)} {passage} {samples.prose(rng, 9)}", *[None] * 8) for k in range(25)]
    rows += [(4000, " ".join(["ja"] * 300), *[None] * 8), (3999, " ".join(["ja"] * 120), *[None] * 8)]
    docs = spark.createDataFrame(rows, samples.SCHEMA).repartition(5)
    got = substrings.removal_digests(docs).collect()
    want = plain([r[:2] for r in rows])
    assert sorted(repr(tuple(r)) for r in got) == want
    assert sum(r.n_removed for r in got) > 24 * 130


def test_kept_text(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c {passage}\nd"), (3, "e")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    assert got == {1: f"a {passage} b", 2: "c d", 3: "e"}


def test_empty_table(spark):
    assert substrings.removal_digests(samples.empty(spark)).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    doc, at = np.repeat([5, 5, 9], [4, 3, 6]), np.array([0, 1, 2, 3, 8, 9, 10, 0, 1, 2, 3, 7, 8])
    hashes = rng.integers(0, 2**56, len(doc)).astype(np.uint64)
    got = substrings.unpacked(substrings.packed(doc, at, hashes))
    assert [x.tolist() for x in got] == [doc.tolist(), at.tolist(), hashes.tolist()]


def test_rolled_hashes_are_those_of_the_windows():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    whole, least = substrings.window_hashes(words)
    again = [substrings.window_hashes(words[k:k + 50]) for k in range(351)]
    assert whole.tolist() == [int(w[0]) for w, _ in again] and least.tolist() == [int(m[0]) for _, m in again]


def common_line(rng):
    """A line of 40 words in a third of the documents, each time between other words."""
    line = samples.prose(rng, 40)
    return [(k, f"{samples.prose(rng, 30)} {line if k % 3 == 0 else ''} {samples.prose(rng, 30)}") for k in range(300)]


def group_sizes(docs, groups):
    sizes = {}
    for row in substrings.windows(docs, groups).where("blob IS NOT NULL").collect():
        sizes[row.bucket] = sizes.get(row.bucket, 0) + len(substrings.unpacked(bytes(row.blob))[0])
    return sizes


def test_no_group_grows_with_a_common_line(spark, monkeypatch):
    docs = spark.createDataFrame(common_line(random.Random(4)), "doc_id bigint, text string").repartition(4, "doc_id")
    whole = group_sizes(docs, np.ones(16, np.int64))
    monkeypatch.setattr(substrings, "GROUP", 200)
    split = group_sizes(docs, substrings.splits(docs, 16))
    assert sum(split.values()) == sum(whole.values())
    assert max(whole.values()) > 1500 and max(split.values()) < 400


def test_split_buckets_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 40)
    monkeypatch.setattr(substrings, "SLAB", 500)
    rng = random.Random(5)
    rows = common_line(rng)
    rows += [(1000 + k, f"{rows[3 * k][1]} {samples.prose(rng, 20)}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = substrings.removal_digests(docs).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)
    assert sum(r.n_removed > 0 for r in got) >= 60
