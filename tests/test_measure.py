import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmatch import MatchOptions, score_postings
from postmatch.operators import measure, pairing
from postmatch.operators.semantic import HashingEncoder, StoredVectors
from postmatch.sinks.tables import Stage
from postmatch.sources.postings import POSTING_SCHEMA

WORDS = "python sql rest api github actions linux river stone c++ ci/cd north éa straße lantern 4 years 2.5 yrs degree aws certified".split()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    titles = ("Data Engineer", "", None, "Stone  <b>", "sql river lantern")
    rows = [(k, k, rng.choice(titles), "", " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))) for k in range(60)]
    rows += [(60, 60, "none", "", None), (61, 61, "none", "", " "), (62, 62, "x", "", "y" * 700 + " sql " + "ab" * 40)]
    people = [(p, " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for p in range(30)]
    people += [(40, ""), (41, "z" * 600 + "sqlpython"), (42, "ab" * 60), (None, "river sql")]
    people += people[:2]  # listed twice
    return spark.createDataFrame(rows, POSTING_SCHEMA), spark.createDataFrame(people, "profile_id long, text string")


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("options", [
    MatchOptions(), MatchOptions(match_mode="token", experience_years=3, top_keywords=4, flag_semantic_errors=True)])
def test_blocks_are_scored_as_pairs_are(spark, tables, tmp_path, options):
    postings, profiles = tables
    whole = score_postings(postings, profiles, options)
    parts = score_postings(postings, profiles, options, stage=Stage(spark, str(tmp_path)), max_profiles=2)
    assert parts.schema.simpleString() == whole.schema.simpleString()
    assert as_rows(parts) == as_rows(whole)
    # No keyword is looked for in a profile's text pair by pair.
    plan = parts.select("posting_id", "ats_score")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "contains(" not in plan


def test_vectors_that_are_not_whole_or_not_there(spark, tables, tmp_path):
    rng = random.Random(4)
    odd = [None, [], [1.5], [0.1, None, 0.3], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 0.0], [0.0, 0.0, 0.0, 0.0]]
    vectors = spark.createDataFrame(
        [(k, odd[k] if k < len(odd) else [rng.uniform(-1, 1) for _ in range(rng.choice((3, 5)))]) for k in range(63)],
        "id long, v array<float>")
    postings, profiles = tables
    coded = postings.join(vectors.withColumnRenamed("id", "posting_id"), "posting_id")
    whose = profiles.join(vectors.withColumnRenamed("id", "profile_id"), "profile_id", "left")
    more = dict(encoder=StoredVectors("v"), options=MatchOptions(weights={n: 1 / 3 for n in MatchOptions().weights}))
    whole, parts = (score_postings(coded, whose, **more, **way) for way in (
        {}, {"stage": Stage(spark, str(tmp_path)), "max_profiles": 5}))
    assert as_rows(parts) == as_rows(whole)


def test_a_task_may_meet_several_blocks(spark, tables, tmp_path):
    postings, profiles = tables
    parts = score_postings(postings, profiles, encoder=HashingEncoder(8), stage=Stage(spark, str(tmp_path)), max_profiles=3)
    want = as_rows(score_postings(postings, profiles, encoder=HashingEncoder(8)))
    assert as_rows(parts.coalesce(1)) == want
    # A filter must not drop the row that brings the block.
    assert parts.where(F.col("posting_id") == 5).count() == profiles.count()
    assert parts.limit(7).count() == 7


def test_terms_are_found_as_in_a_text():
    texts = ["rest api in c++ and ci/cd", "", "z" * 600 + " sql", "éa straße"]
    entry = pa.array([[]] * 4, pa.list_(pa.struct([("at", pa.int32()), ("x", pa.float64())])))
    block = measure.Block(pa.StructArray.from_arrays(
        [pa.array(texts), pa.array([["sql"]] * 4), pa.array([None] * 4, pa.float64()), pa.array([0.0] * 4), entry],
        ["text", "skills", "years", "norm", "vector"]))
    terms = ["rest api", "t a", "c++", "c", "z" * 30, "zsql", " sql", "sql", "a s", "ß", "", "q" * 700]
    assert block.contained(terms).tolist() == [[float(t in text) for text in texts] for t in terms]


def test_blocks_pass_over_the_postings_together(spark, tables, tmp_path, monkeypatch):
    postings, profiles = tables
    want = as_rows(score_postings(postings, profiles))

    def scored(folder):
        parts = score_postings(postings, profiles, stage=Stage(spark, str(tmp_path / folder)), max_profiles=3)
        plan = parts.select("posting_id", "profile_id", "ats_score")._jdf.queryExecution().optimizedPlan().toString()
        # A pair's score alone leaves the arrays.
        assert "_measured_ats_score" in plan and "_measured_skill_match" not in plan
        return as_rows(parts), plan.count("signals(")

    assert scored("one") == (want, 1)
    monkeypatch.setattr(pairing, "MAX_PROFILES", 6)
    assert scored("six") == (want, 6)


@pytest.mark.parametrize("most", [1, 7, 40, 1 << 22])
def test_few_sums_at_once_give_the_same(monkeypatch, most):
    monkeypatch.setattr(measure, "MOST_SUMS", most)
    rng = random.Random(most)
    texts = ["".join(rng.choices("ab ", k=rng.randint(0, 40))) for _ in range(19)] + [None, "b" * 600 + "a"]
    entry = pa.array([[]] * 21, pa.list_(pa.struct([("at", pa.int32()), ("x", pa.float64())])))
    block = measure.Block(pa.StructArray.from_arrays(
        [pa.array(texts), pa.array([[]] * 21, pa.list_(pa.string())), pa.array([None] * 21, pa.float64()), pa.array([0.0] * 21), entry],
        ["text", "skills", "years", "norm", "vector"]))
    lists = [["a", "ab", "bb"], None, [], ["aab"], ["b", "a b", "aaaa", "bab", "ba"] * 3]
    coded = measure.Lists(pa.array([None if x is None else [{"token": t, "weight": k} for k, t in enumerate(x)] for x in lists],
                                   pa.list_(pa.struct([("token", pa.string()), ("weight", pa.int64())]))), True)
    rows = [4, 0, 1, 3, 4, 2]
    got = coded.sums(block.holders(coded.terms), 21, np.array(rows))
    assert got.tolist() == [[float(sum(k for k, t in enumerate(lists[r] or []) if t in (text or ""))) for text in texts] for r in rows]
