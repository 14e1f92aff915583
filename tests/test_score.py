import pytest
from pyspark.sql import functions as F

from postmatch import MatchOptions, fixed, score_postings
from postmatch.operators.score import SCORE_COLUMNS, recommendation, report_columns, weighted_score
from postmatch.operators.semantic import HashingEncoder, ModelEncoder, StoredVectors
from postmatch.sinks.tables import staging
from tests.samples import CASES, RESUME, STRONG, WEAK

POSTING = "posting_id long, job_title string, job_link string, job_description string"


def profile(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "profile_id long, text string")


def posting(spark, *rows):
    return spark.createDataFrame([(i, t, "", d) for i, (t, d) in enumerate(rows)], POSTING)


@pytest.fixture(scope="module")
def golden(spark):
    found = {}
    for name, resume, text, title, *_ in CASES:
        found[name] = score_postings(posting(spark, (title, text)), profile(spark, resume)).first()
    return found


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_golden_components(golden, case):
    name, _, _, _, matched, missing, skill, title, experience, education = case
    row = golden[name]
    assert ", ".join(row.matched_skills) == matched
    assert ", ".join(row.missing_skills) == missing
    assert (row.skill_match, row.title_match) == (skill, title)
    assert (row.experience_match, row.education_bonus) == (experience, education)


def test_empty_description(golden):
    row = golden["empty"]
    assert all(row[name] == 0.0 for name in SCORE_COLUMNS[:7])
    assert row.recommendation == fixed.NO_DESCRIPTION


def test_strong_beats_weak_and_scores_stay_in_bounds(golden):
    assert golden["strong"].ats_score > golden["weak"].ats_score
    for row in golden.values():
        assert all(0.0 <= row[name] <= 100.0 for name in SCORE_COLUMNS[:7])


def test_score_is_the_weighted_sum_of_its_parts(golden):
    for name, row in golden.items():
        if name != "empty":
            total = sum(row[part] * weight for part, weight in fixed.WEIGHTS.items())
            assert row.ats_score == pytest.approx(total, abs=0.01)


@pytest.mark.parametrize(
    "score, missing, expected",
    [
        (44.99, 1, fixed.LOW_WITH_MISSING), (44.99, 0, fixed.LOW_WITHOUT_MISSING),
        (45.0, 1, fixed.RECOMMENDATIONS[2][1]), (64.99, 0, fixed.RECOMMENDATIONS[2][1]),
        (65.0, 1, fixed.RECOMMENDATIONS[1][1]), (79.99, 0, fixed.RECOMMENDATIONS[1][1]),
        (80.0, 0, fixed.RECOMMENDATIONS[0][1]), (100.0, 1, fixed.RECOMMENDATIONS[0][1]),
    ],
)
def test_recommendation(one, score, missing, expected):
    skills = F.expr("array('x')" if missing else "array()")
    assert one(recommendation(F.lit(score), skills)) == expected


def test_advice_uses_all_missing_skills_though_twelve_show(spark):
    text = "hiring with " + ", ".join(fixed.SKILLS)
    row = score_postings(posting(spark, ("", text)), profile(spark, "nothing")).first()
    assert set(row.missing_skills) == set(fixed.SKILLS)
    assert row.recommendation == fixed.LOW_WITH_MISSING
    shown = report_columns(score_postings(posting(spark, ("", text)), profile(spark, "nothing"))).first()
    assert len(shown["Missing Skills"].split(", ")) == 12


def test_other_weights(one):
    weights = {name: 0.0 for name in fixed.WEIGHTS} | {"skill_match": 2.0}
    parts = {name: F.lit(60.0) for name in fixed.WEIGHTS}
    assert one(weighted_score(parts, weights)) == 100.0


def test_years_override(spark):
    postings = posting(spark, ("", "needs 4 years"))
    scored = score_postings(postings, profile(spark, "9 years"), MatchOptions(experience_years=1.0))
    assert scored.first().experience_match == 25.0


def test_skills_split_into_matched_and_missing(spark):
    postings = posting(spark, ("a", STRONG), ("b", WEAK), ("c", "java and javascript, excel"))
    for row in score_postings(postings, profile(spark, RESUME, "java")).collect():
        assert not set(row.matched_skills) & set(row.missing_skills)
        assert row.matched_skills == sorted(row.matched_skills)


def test_partitioning_does_not_change_scores(spark):
    rows = [(f"title {i}", f"{STRONG} word{i} " * (i % 5)) for i in range(40)]
    postings = posting(spark, *rows)
    results = [
        sorted(map(str, score_postings(postings.repartition(n), profile(spark, RESUME)).collect()))
        for n in (1, 3, 8)
    ]
    assert results[0] == results[1] == results[2]


def test_no_postings_keep_the_schema(spark):
    empty = posting(spark, ("t", "d")).limit(0)
    scored = score_postings(empty, profile(spark, RESUME))
    assert scored.count() == 0
    assert scored.columns == [*empty.columns, "profile_id", *SCORE_COLUMNS]


def test_report_columns(spark):
    shown = report_columns(score_postings(posting(spark, ("t", STRONG)), profile(spark, RESUME)))
    assert shown.columns == ["Job Title", "Job Link", "Job Description", "posting_id", "profile_id",
                             *fixed.SCORE_HEADERS.values()]
    assert shown.first()["Matched Skills"].startswith("airflow, docker")


def test_same_text_is_fully_similar(spark):
    row = score_postings(posting(spark, ("", RESUME)), profile(spark, RESUME)).first()
    assert row.semantic_match == 100.0


def test_blocks_of_profiles_give_the_same_pairs_without_shuffling_postings(spark, tmp_path):
    postings = posting(spark, *[(f"t{i}", f"{STRONG} word{i}") for i in range(12)])
    postings.write.parquet(str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    many = profile(spark, *[f"{RESUME} word{i}" for i in range(25)])
    whole, parts = (score_postings(postings, many, max_profiles=n) for n in (256, 4))
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "SinglePartition" not in line]
    assert moved == [] and "Join" not in plan


def test_profiles_are_assembled_once_for_all_blocks(spark, tmp_path):
    posting(spark, ("", "linux"), ("", "sql")).write.parquet(str(tmp_path / "p"))
    profile(spark, *[f"{RESUME} word{i}" for i in range(25)]).write.parquet(str(tmp_path / "whole"))
    postings, many = (spark.read.parquet(str(tmp_path / name)) for name in ("p", "whole"))
    with staging(spark, str(tmp_path / "stage")) as stage:
        parts = score_postings(postings, many, max_profiles=4, stage=stage)
        plan = parts._jdf.queryExecution().executedPlan().toString()
        assert f"{tmp_path}/whole" not in plan and f"{tmp_path}/p]" not in plan
        # Seven blocks, each of which reads its own folder of the staged profiles.
        assert plan.count("PartitionFilters: [isnotnull(_part") >= 7
        assert sorted(map(str, parts.collect())) == sorted(map(str, score_postings(postings, many).collect()))


def test_an_encoder_is_not_run_to_measure_profiles(spark):
    class Counting(StoredVectors):
        def encode(self, df, text, words, out):
            refuse = F.raise_error(F.lit("encoded")).cast("array<float>")
            return df.withColumn(out, F.when(F.col(text) != "", refuse))

    score_postings(posting(spark, ("", "x")), profile(spark, "abc"), encoder=Counting("v"))


def test_stored_vectors(spark):
    postings = posting(spark, ("", "abc"), ("", "abc"), ("", "")).withColumn(
        "v", F.when(F.col("posting_id") != 1, F.expr("array(3f, 4f)"))
    )
    whose = profile(spark, "x").withColumn("v", F.expr("array(4f, 3f)"))
    scored = score_postings(postings, whose, encoder=StoredVectors("v"))
    assert [r.semantic_match for r in scored.orderBy("posting_id").collect()] == [96.0, 0.0, 0.0]


def test_model_encoder_gives_zero_where_the_model_refuses(spark):
    def load_toy_model():
        def encode(texts):
            if any("bad" in text for text in texts):
                raise ValueError("cannot encode")
            return [[float(len(text)), 1.0] for text in texts]

        return encode

    postings = posting(spark, ("", "good"), ("", "bad text"), ("", "fine words"))
    scored = score_postings(postings, profile(spark, "good"), encoder=ModelEncoder(load_toy_model))
    by_id = {r.posting_id: r.semantic_match for r in scored.collect()}
    assert by_id[0] == 100.0 and by_id[1] == 0.0 and 90.0 < by_id[2] < 100.0


def test_hashing_encoder_width(spark):
    df = spark.createDataFrame([(["a", "b", "a"],)], "w array<string>")
    vector = HashingEncoder(16).encode(df, "t", "w", "v").first().v
    assert len(vector) == 16 and sum(vector) == 3.0
