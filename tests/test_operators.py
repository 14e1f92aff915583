import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postmatch.functions.text import content_tokens, normalise, tokens
from postmatch.operators import features, keywords, skills
from postmatch.operators.pairing import every_pair, keyed_pairs
from postmatch.operators.rank import by_score, top_matches, top_per_profile
from postmatch.operators.score import posting_features
from postmatch.operators.semantic import HashingEncoder
from postmatch.operators.skew import salted_join, top_per_group
from postmatch.options import MatchOptions

OPTIONS = MatchOptions()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- keywords --------------------------------------------------------------

TEXTS = [
    (1, "python qa python alpha beta. alpha rest api testing with the gamma"),
    (2, ""),
    (3, "a an the of 12 34"),
    (4, "qa"),
    (5, "zeta " * 40 + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60))),
    (6, "javascript java postgresql ci/cd ci/cd kubernetes " + "x" * 70),
    (7, "same same same other other python"),
]


def words_of(spark):
    df = spark.createDataFrame(TEXTS, "posting_id long, text string")
    read = df.withColumn("text", normalise(F.col("text")))
    return read.withColumn("words", content_tokens(tokens(F.col("text")), OPTIONS.stop_list()))


def relational_keywords(df, top):
    """The same keywords by exploding and grouping, as a check."""
    exploded = df.select("posting_id", F.posexplode("words").alias("pos", "token"))
    counted = exploded.groupBy("posting_id", "token").agg(
        F.count("*").alias("n"), F.min("pos").alias("pos")
    )
    boost = (
        df.where(F.size("words") > 0)
        .select("posting_id", F.explode(skills.skills_in(F.col("text"), OPTIONS)).alias("token"))
        .select("posting_id", "token", F.lit(2).cast("long").alias("n"), F.lit(2**31 - 1).alias("pos"))
    )
    weighed = counted.unionByName(boost).groupBy("posting_id", "token").agg(
        F.sum("n").alias("weight"), F.min("pos").alias("pos")
    )
    order = Window.partitionBy("posting_id").orderBy(F.desc("weight"), "pos", "token")
    ranked = weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("posting_id", "token", "weight", "rank")


@pytest.mark.parametrize("top", [1, 3, 25, 1000])
def test_keywords_equal_the_relational_form(spark, top):
    df = words_of(spark)
    mine = keywords.weighted_keywords(
        F.col("words"), skills.skills_in(F.col("text"), OPTIONS), top
    )
    got = df.select("posting_id", F.explode(mine).alias("k")).select("posting_id", "k.*")
    assert rows(got) == rows(relational_keywords(df, top))


def test_keywords_without_cut_keep_everything(spark):
    df = words_of(spark)
    mine = keywords.weighted_keywords(F.col("words"), skills.skills_in(F.col("text"), OPTIONS))
    got = df.select("posting_id", F.explode(mine).alias("k")).select("posting_id", "k.*")
    assert rows(got) == rows(relational_keywords(df, 10_000))


def test_term_counts_equal_a_counter(spark):
    df = words_of(spark).select("words", keywords.term_counts(F.col("words")).alias("c"))
    for row in df.collect():
        assert {c.token: c.n for c in row.c} == Counter(row.words)
        assert all(row.words.index(c.token) == c.first_pos for c in row.c)


def test_no_tokens_means_no_keywords(spark):
    df = spark.createDataFrame([("c# qa r",)], "text string")  # skills, but no long token
    words = content_tokens(tokens(F.col("text")), OPTIONS.stop_list())
    found = df.select(
        keywords.weighted_keywords(words, skills.skills_in(F.col("text"), OPTIONS), 25).alias("k")
    )
    assert found.first().k == []


def test_keyword_match(spark):
    df = spark.createDataFrame([("aaa bbb bbb ccc",)], "text string")
    listed = keywords.weighted_keywords(tokens(F.col("text")), F.expr("array()").cast("array<string>"), 25)
    match = keywords.keyword_match(F.lit("xbbbx"), listed)
    assert df.select(match.alias("m")).first().m == 50.0


# --- title, experience, education, skills ----------------------------------


@pytest.mark.parametrize(
    "given, expected",
    [
        ("5+ years of experience, 2-4 yrs exp; 18 years old", 18.0),
        ("2.5 yrs", 2.5), ("none", None), ("10years", 10.0), ("0 + year of exp", 0.0),
    ],
)
def test_max_years(one, given, expected):
    assert one(features.max_years(F.col("x")), x=given) == expected


@pytest.mark.parametrize(
    "required, offered, expected",
    [("NULL", "NULL", 100.0), ("0", "0", 100.0), ("0", "NULL", 0.0), ("3", "NULL", 0.0),
     ("7", "2", 28.57), ("2", "8", 100.0)],
)
def test_experience_match(one, required, offered, expected):
    years = "cast({} as double)".format
    column = features.experience_match(F.expr(years(required)), F.expr(years(offered)))
    assert one(column) == expected


def test_education(one):
    required = features.required_education(F.col("d"), OPTIONS)
    bonus = features.education_bonus(F.col("r"), required)
    assert one(bonus, d="any", r="") == 100.0
    assert one(bonus, d="bachelor or master, aws certified", r="a master") == 25.0


def test_title_match_counts_distinct_words(one):
    words = features.title_tokens(normalise(F.col("t")), OPTIONS)
    match = features.title_match(F.col("r"), words)
    assert one(match, t="Test test Lead", r="tester") == 50.0
    assert one(match, t="of a", r="of a") == 0.0


def test_skill_sets(one):
    ours, theirs = F.expr("array('a','b','c')"), F.expr("array('c','a','x')")
    assert one(skills.matched_skills(ours, theirs)) == ["a", "c"]
    assert one(skills.missing_skills(ours, theirs)) == ["b"]
    many = F.array(*[F.lit(f"s{i:02d}") for i in range(20)])
    assert len(one(skills.shown_missing(many, OPTIONS))) == 12
    assert one(skills.skill_match(F.expr("array()"), F.expr("array()"))) == 0.0


# --- pairing and skew ------------------------------------------------------


def test_blocks_pair_like_the_small_way(spark):
    left = spark.range(50).withColumnRenamed("id", "posting_id")
    right = spark.range(9).select(F.col("id").alias("profile_id"), F.lit("t").alias("text"))
    small = every_pair(left, right)
    blocks = every_pair(left, right, max_profiles=2)
    tiny = every_pair(left, right, max_bytes=40)
    pick = lambda df: rows(df.select("posting_id", "profile.profile_id"))
    assert pick(small) == pick(blocks) == pick(tiny)
    assert len(pick(small)) == 450
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString()


def test_no_profile_gives_no_pair(spark):
    left = spark.range(5).withColumnRenamed("id", "posting_id")
    right = spark.range(0).select(F.col("id").alias("profile_id"), F.lit("t").alias("text"))
    assert every_pair(left, right).count() == 0


def test_keyed_pairs_broadcast_and_salted_agree(spark):
    left = spark.range(200).select(
        F.col("id").alias("posting_id"), F.when(F.col("id") < 120, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("search")
    )
    right = spark.createDataFrame([(1, "hot"), (2, "hot"), (3, "k1"), (4, "zz")], "profile_id long, search string")
    pick = lambda df: rows(df.select("posting_id", "profile.profile_id"))
    assert pick(keyed_pairs(left, right, "search")) == pick(
        keyed_pairs(left, right, "search", max_bytes=0)
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(300).select(
        F.col("id").alias("posting_id"),
        F.when(F.col("id") < 100, F.lit("hot")).when(F.col("id") < 110, F.lit(None)).otherwise((F.col("id") % 20).cast("string")).alias("k"),
    )
    right = spark.createDataFrame([("hot", 1), ("3", 2), ("3", 3), ("none", 4)], "k string, v int")
    salted = salted_join(left, right, "k", how=how, spread_by="posting_id", hot_rows=10)
    assert rows(salted.select("k", "posting_id", "v")) == rows(
        left.join(right, "k", how).select("k", "posting_id", "v")
    )


@pytest.mark.parametrize("k", [1, 7, 500])
def test_top_per_group_with_a_hot_group_and_ties(spark, k):
    df = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
        (F.col("id") % 4).alias("score"),
    )
    order = [F.desc("score"), F.asc("id")]
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= k)
    mine = top_per_group(df, ["g"], order, k, salts=8)
    assert rows(mine.select(*plain.columns)) == rows(plain)


def test_ranking(spark):
    df = spark.createDataFrame(
        [(1, 1, 5.0), (1, 2, 7.0), (2, 3, 7.0), (2, 1, 7.0), (1, 3, 7.0)],
        "profile_id long, posting_id long, ats_score double",
    )
    order = [(r.ats_score, r.posting_id, r.profile_id) for r in by_score(df).collect()]
    assert order == [(7.0, 1, 2), (7.0, 2, 1), (7.0, 3, 1), (7.0, 3, 2), (5.0, 1, 1)]
    assert [(r.posting_id, r.profile_id) for r in top_matches(df, 2).collect()] == [(1, 2), (2, 1)]
    best = top_per_profile(df, 2)
    assert rows(best.select("profile_id", "posting_id", "rank")) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2)]


def test_weighted_keywords_as_counted_plainly(spark):
    """Every cut, texts with few or many repeated tokens, skills that are tokens or not."""
    rng = random.Random(5)
    rows = []
    for n in (0, 1, 3, 30, 30, 200, 200):
        words = [rng.choice(["sql", "git", *(f"w{i}" for i in range(rng.choice([4, 80])))]) for _ in range(n)]
        rows.append((len(rows), words, sorted(rng.sample(["ci/cd", "git", "java", "rest api", "sql"], rng.randint(0, 5)))))

    def plain(words, skills, top):
        if not words:
            return []
        weight = {w: words.count(w) + 2 * (w in skills) for w in words}
        order = [(-n, 0, words.index(w), w) for w, n in weight.items()]
        order += [(-2, 1, i, s) for i, s in enumerate(sorted(set(skills) - set(words)))]
        return [(w, -n, i) for i, (n, _, _, w) in enumerate(sorted(order)[:top], 1)]

    df = spark.createDataFrame(rows, "id int, words array<string>, skills array<string>")
    for top in (None, 1, 5, 25):
        for row in df.withColumn("got", keywords.weighted_keywords(F.col("words"), F.col("skills"), top)).collect():
            assert [tuple(k) for k in row.got] == plain(row.words, row.skills, top), (row.id, top)


def test_tokens_seen_once_are_not_sorted_with_their_positions(spark):
    """Only repeated or boosted tokens get a struct; the texts' other tokens are sorted as strings."""
    df = spark.createDataFrame([(["b", "a", "c"], ["x"])], "words array<string>, skills array<string>")
    plan = df.select(keywords.weighted_keywords(F.col("words"), F.col("skills"), 25))._jdf.queryExecution().analyzed().toString()
    assert "sort_array(words" in plan and "array_except" in plan


def test_keywords_in_batches_equal_those_of_a_row(spark):
    """The same ranks from Arrow batches, without a lambda; rows of nulls and a cut within a batch too."""
    rng = random.Random(9)
    words = ["sql", "git", "straße", *(f"w{i}" for i in range(60))]
    rows = [(k, rng.choices(words, k=n), sorted(rng.sample(["ci/cd", "git", "java", "rest api", "sql"], rng.randint(0, 5))))
            for k, n in enumerate([0, 1, 2, 30, 400, 0, 90] * 4)]
    rows += [(100, None, ["git"]), (101, ["git"], None), (102, None, None), (103, ["java", "java"], ["sql"])]
    df = spark.createDataFrame(rows, "id int, words array<string>, skills array<string>").coalesce(1)
    for top in (None, 1, 25):
        way = [keywords.weighted_keywords(F.col("words"), F.col("skills"), top, in_batches=b) for b in (False, True)]
        found = df.select("id", way[0].alias("row"), way[1].alias("batch"))
        assert found.schema["row"].dataType.simpleString() == found.schema["batch"].dataType.simpleString()
        for r in found.collect():
            assert r.row == r.batch, (r.id, top)
    assert "lambda" not in df.select(way[1])._jdf.queryExecution().analyzed().toString()
    # Rows are counted in slices of bounded size, whatever the batch.
    lists = [pa.array([r[c] for r in rows], pa.list_(pa.string())) for c in (1, 2)]
    whole = keywords._counted(*lists, 25).to_pylist()
    parts = [keywords._counted(*(x.slice(k, 3) for x in lists), 25) for k in range(0, len(rows), 3)]
    assert pa.concat_arrays(parts).to_pylist() == whole


@pytest.mark.parametrize("wanted", [["_keywords"], ["_weight"], ["_keywords", "_weight"], ["posting_id", "_keywords", "_vector"]])
def test_keywords_come_whatever_else_is_read(spark, wanted):
    """Spark inlines features that nothing else reads; the function over them is still evaluated."""
    postings = spark.createDataFrame([(1, "x", "sql sql river 4 years"), (2, "", None)], "posting_id long, job_title string, job_description string")
    found = posting_features(postings, OPTIONS, HashingEncoder(8)).select(*wanted)
    assert found.count() == 2 and len(found.collect()) == 2
    if "_keywords" in wanted:
        listed = found.select(F.explode_outer("_keywords").alias("k")).where("k IS NOT NULL").select("k.token", "k.weight")
        assert rows(listed) == [("river", 1), ("sql", 4), ("years", 1)]
