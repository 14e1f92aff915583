import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmatch import MatchOptions, fixed, score_postings
from postmatch.operators import pruned, seekers
from postmatch.operators.pruned import pruned_top, scored_candidates
from postmatch.operators.rank import top_per_profile
from postmatch.operators.semantic import StoredVectors
from postmatch.sinks.tables import Stage
from postmatch.sources.postings import POSTING_SCHEMA

ROLES = [("Data Engineer", "airflow etl python postgresql kubernetes"), ("Test Lead", "appium jmeter postman jira bdd"),
         ("Web Developer", "javascript typescript graphql cypress"), ("Florist", "bouquets weddings deliveries"),
         ("Gardener", "planting pruning paths tools"), ("Linux Admin", "linux unix docker git jenkins")]
WORDS = "north south river stone cloud early late quiet market bridge lantern harbour meadow".split()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    rows = []
    for k in range(900):
        title, words = ROLES[rng.randrange(6)]
        text = " ".join(rng.choices(words.split(), k=6) + rng.choices(WORDS, k=20))
        text += rng.choice(("", f" {rng.randint(1, 9)} years", " bachelor degree"))
        rows.append((k, k, title, "", text if k % 50 else rng.choice(("", None))))
    # Ties of the best rows, listed far from each other.
    rows += [(k, k, "Data Engineer", "", "airflow etl python postgresql kubernetes") for k in (905, 1, 903, 904)]
    people = [(p, f"{title} with {words}, {p + 2} years. " + " ".join(rng.choices(WORDS, k=9)))
              for p, (title, words) in enumerate(ROLES)]
    people += [(10, "unix docker bouquets market"), (11, "zzz"), (12, "the of and")]
    return (spark.createDataFrame(rows, POSTING_SCHEMA).where("posting_id != 1 OR job_title != ''").dropDuplicates(["posting_id"]),
            spark.createDataFrame(people, "profile_id long, text string"))


def as_rows(df):
    return sorted(map(tuple, df.select("profile_id", "posting_id", "ats_score", "rank").collect()))


@pytest.mark.parametrize("k", [1, 10])
def test_equals_ranking_all_pairs_and_scores_few(spark, tables, tmp_path, k):
    postings, profiles = tables
    stage = Stage(spark, str(tmp_path))
    want = as_rows(top_per_profile(score_postings(postings, profiles), k))
    assert as_rows(pruned_top(postings, profiles, k=k, stage=stage)) == want
    known = profiles.where("profile_id IN (0, 1, 2, 5)")  # those with skills
    pairs = scored_candidates(postings, known, k=k, stage=stage)
    assert pairs.count() == pairs.select("profile_id", "posting_id").distinct().count()
    assert pairs.count() * 2 < known.count() * postings.count()


def test_fewer_postings_than_asked_for_and_none(spark, tables, tmp_path):
    postings, profiles = tables
    stage = Stage(spark, str(tmp_path))
    few = postings.where("posting_id < 5")
    assert as_rows(pruned_top(few, profiles, stage=stage)) == as_rows(top_per_profile(score_postings(few, profiles)))
    assert as_rows(pruned_top(postings.where("false"), profiles, stage=stage)) == []
    assert as_rows(pruned_top(few, profiles.where("false"), stage=stage)) == []


def test_vectors_of_any_sign(spark, tables, tmp_path):
    rng = random.Random(2)
    postings, profiles = tables
    vectors = spark.createDataFrame(
        [(k, [rng.uniform(-1, 1) for _ in range(6)] if k % 9 else None) for k in range(910)], "id long, v array<float>")
    coded = postings.join(vectors.withColumnRenamed("id", "posting_id"), "posting_id", "left")
    whose = profiles.join(vectors.withColumnRenamed("id", "profile_id"), "profile_id", "left")
    options = MatchOptions(weights={"semantic_match": 0.9, "skill_match": 0.02, "keyword_match": 0.02,
                                    "title_match": 0.02, "experience_match": 0.02, "education_bonus": 0.02})
    want = as_rows(top_per_profile(score_postings(coded, whose, options, StoredVectors("v"))))
    got = pruned_top(coded, whose, options, stage=Stage(spark, str(tmp_path)), encoder=StoredVectors("v"), max_profiles=4)
    assert as_rows(got) == want


def test_a_weight_below_zero_is_refused(spark, tables, tmp_path):
    weights = dict(MatchOptions().weights, title_match=-0.1)
    with pytest.raises(ValueError):
        pruned_top(*tables, MatchOptions(weights=weights), stage=Stage(spark, str(tmp_path)))


def test_alike_postings_are_not_all_returned(spark, tables, tmp_path):
    """Where bounds tell no postings apart, a task still returns at most k of them for a profile."""
    rng = random.Random(5)
    rows = [(k, k, "Gardener", "", " ".join(rng.choices(WORDS, k=12))) for k in range(400)]
    postings = spark.createDataFrame(rows, POSTING_SCHEMA).repartition(4)
    people = spark.createDataFrame([(p, " ".join(rng.choices(WORDS, k=8))) for p in range(6)], "profile_id long, text string")
    pairs = scored_candidates(postings, people, k=2, stage=Stage(spark, str(tmp_path)), max_profiles=4)
    # Four tasks, two passes.
    assert pairs.groupBy("profile_id").count().where("count > 2 * 4 * 2").count() == 0
    assert as_rows(top_per_profile(pairs, 2)) == as_rows(top_per_profile(score_postings(postings, people), 2))


def test_ids_that_repeat_or_are_none(spark, tables, tmp_path):
    postings, profiles = tables
    postings = postings.where("posting_id % 5 = 0")
    postings = postings.unionAll(postings.where("posting_id % 20 = 0")).unionAll(
        postings.where("posting_id = 25").withColumn("posting_id", F.lit(None).cast("long")))
    none = profiles.where("profile_id < 2").withColumn("profile_id", F.lit(None).cast("long"))
    whose = profiles.unionAll(profiles.where("profile_id = 3")).unionAll(none)
    got = pruned_top(postings, whose, stage=Stage(spark, str(tmp_path)), max_profiles=8)
    want = top_per_profile(score_postings(postings, whose))
    columns = ["profile_id", "posting_id", "ats_score", "rank"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_vectors_that_are_not_finite_or_not_there(spark, tables, tmp_path):
    rng = random.Random(6)
    odd = [None, [], [1.5], [0.1, None, 0.3], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 0.0], [0.0, 0.0, 0.0, 0.0]]
    vectors = spark.createDataFrame(
        [(k, odd[k] if k < len(odd) else [rng.uniform(-1, 1) for _ in range(rng.choice((3, 5)))]) for k in range(80)],
        "id long, v array<float>")
    postings, profiles = tables
    coded = postings.join(vectors.withColumnRenamed("id", "posting_id"), "posting_id")
    whose = profiles.join(vectors.withColumnRenamed("id", "profile_id"), "profile_id", "left")
    options = MatchOptions(weights={n: 1 / 3 for n in MatchOptions().weights}, top_keywords=4)
    got = pruned_top(coded, whose, options, k=3, stage=Stage(spark, str(tmp_path)), encoder=StoredVectors("v"), max_profiles=5)
    assert as_rows(got) == as_rows(top_per_profile(score_postings(coded, whose, options, StoredVectors("v")), 3))


@pytest.mark.parametrize("few", [0, 64])
def test_terms_are_known_as_they_are_in_a_text(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(pruned, "FEW_SPACED", few)
    texts = ["rest api in c++ and ci/cd", "", "z" * 600 + " sql", "éa straße rest", "restapi"]
    terms = ["rest api", "api in c", "c++", "t a", "z" * 30, "zsql", "sql", "rest", "ß", "cd"]
    right = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    found = pruned.known_terms(right, spark.createDataFrame([(t,) for t in terms], "term string"), Stage(spark, str(tmp_path)))
    got = {row: sorted(known) for row, known in found.collect() if known}
    want = {row: sorted(t for t in terms if t in text) for row, text in enumerate(texts)}
    assert got == {row: known for row, known in want.items() if known}


def test_profiles_terms_are_looked_at_once_a_batch(monkeypatch):
    """However few rows are met at once."""
    entry = pa.list_(pa.struct([("at", pa.int32()), ("x", pa.float64())]))
    words = pa.list_(pa.string())
    profiles = pa.StructArray.from_arrays(
        [pa.array([0, 1]), pa.array([7, 8]), pa.array([True, True]), pa.array([["sql"], []], words), pa.array([1.0, None]),
         pa.array([[(0, 1.0)], [(1, 2.0)]], entry), pa.array([1.0, 2.0]), pa.array([["sql", "river"], ["river"]], words),
         pa.array([[], []], pa.list_(pa.int64())), pa.array([None, None], pa.float64())],
        ["_row", "profile_id", "has_text", "skills", "years", "vector", "norm", "known", "_first", "_least"])
    n = 40
    keywords = pa.array([[{"token": t, "weight": 1 + k % 3} for t in ("river", "sql", "none")[:k % 4]] for k in range(n)],
                        pa.list_(pa.struct([("token", pa.string()), ("weight", pa.int64())])))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([k >> 5 for k in range(n)]), pa.array(["a"] * n), pa.array([True] * n), pa.array([["sql"]] * n, words),
         pa.array([["river"]] * n, words), pa.array([None] * n, pa.float64()), pa.array([[]] * n, words), keywords, pa.array([9] * n),
         pa.array([[1.0, float(k)] for k in range(n)], pa.list_(pa.float32())), pa.array([(1 + k * k) ** 0.5 for k in range(n)]),
         pa.ListArray.from_arrays(pa.array([0] + [2] * n, pa.int32()), profiles, mask=pa.array([False] + [True] * (n - 1)))],
        ["posting_id", "_block", "_kind", *seekers.KIND, "_keywords", "_weight", "_vector", "_norm", "_profiles"])
    looks = []
    codes = seekers.Index.codes
    monkeypatch.setattr(seekers.Index, "codes", lambda self, terms: looks.append(len(terms)) or codes(self, terms))

    def found():
        return [part.to_pydict() for part in seekers.best_pairs(fixed.WEIGHTS, 3, False)(iter([batch]))]

    want = found()
    monkeypatch.setattr(seekers, "MOST_CELLS", 8)
    looks.clear()
    assert found() == want and len(want[0]["ats_score"]) == 6
    assert looks.count(3) == 1  # the three keywords; kinds of postings look for one term each
