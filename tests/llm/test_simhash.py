import numpy as np
import xxhash
from pyspark.sql import functions as F

from postmatch.llm import simhash
from tests.llm import odd_tables as samples


def plain_print(text):
    words = samples.split(samples.lower(text))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rng, base, n):
    values = base[rng.integers(0, len(base), n)].copy()
    for _ in range(4):
        values ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(values)


def test_trie_join_finds_every_pair_once():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    for n, m in ((40, 60), (900, 700)):
        a, b = near(rng, base, n), near(rng, base, m)
        got = [(int(i), int(j)) for x, y in simhash.trie_join(a, b, False) for i, j in zip(x, y)]
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(a[:, None] ^ b) <= 3))))
        assert len(got) == len(set(got)) and set(got) == want
        same = {tuple(sorted((int(i), int(j)))) for x, y in simhash.trie_join(a, a, True) for i, j in zip(x, y) if i != j}
        assert same == {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a) <= 3)) if i < j}


def plain_components(ids, prints):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    array = np.array(prints, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(array[:, None] ^ array) <= 3)):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(root(k), []).append(k)
    out = [None] * len(ids)
    for members in groups.values():
        known = [ids[k] for k in members if ids[k] is not None]
        for k in members:
            out[k] = min(known) if known else None
    return out


def test_documents_match_brute_force(spark):
    rows = samples.rows()
    prints = [plain_print(r[1]) for r in rows]
    parts = plain_components([r[0] for r in rows], prints)
    want = sorted(repr((r[0], f"{p:016x}", c)) for r, p, c in zip(rows, prints, parts))
    got = simhash.components(samples.documents(spark)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert len(set(parts)) < len(rows) - 8


def test_chunks_of_a_large_group_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(4)
    values = near(rng, rng.integers(0, 2**63, 3).astype(np.uint64), 150)
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    stars = {r.node: r.root for r in simhash.connected(simhash.links(prints)).collect()}
    whole = values.view(np.int64).tolist()
    want = plain_components(whole, values)
    labels = [stars.get(v, v) for v in whole]
    assert len(set(zip(labels, want))) == len(set(labels)) == len(set(want))


def test_one_row_of_each_group_stays(spark):
    docs = samples.documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = simhash.components(docs).where("doc_id = component_id").select("doc_id").distinct()
    ids = [r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in found.collect())
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.one_of_each(samples.empty(spark)).count() == 0


def test_a_chain_has_one_least_node(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)], "a bigint, b bigint").repartition(4)
    found = simhash.connected(edges).collect()
    assert {r.root for r in found} == {0} and len(found) == 60


def test_a_column_may_have_any_name(spark):
    docs = samples.documents(spark).withColumn("_kept_id", F.lit("own")).withColumn("_KEPT_ID_", F.lit(1))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("_kept_id = 'own'").count() == simhash.one_of_each(samples.documents(spark)).count()
