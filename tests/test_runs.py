import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmatch import MatchOptions, run_match, score_new_files, score_postings
from postmatch.operators.rank import top_matches, top_per_profile
from postmatch.sinks import report
from postmatch.sinks.tables import (
    shared_folder, staging, stamped, with_postings, write_display, write_scored, write_without_clobbering,
)
from postmatch.operators.score import SCORE_COLUMNS
from postmatch.sources.postings import POSTING_SCHEMA
from postmatch.streaming.incremental import scored_so_far
from postmatch_checks import queries
from tests.samples import RESUME, STRONG, WEAK


@pytest.fixture
def postings(spark):
    rows = [(i, i, f"Role {i % 7}", f"https://h/jobs/view/{i}", f"{STRONG} extra{i}" if i % 3 else WEAK if i % 2 else "") for i in range(60)]
    return spark.createDataFrame(rows, POSTING_SCHEMA)


@pytest.fixture
def parts(spark):
    return spark.createDataFrame([(1, 0, RESUME)], "profile_id long, part_no int, text string")


def as_rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(root)
    assert shared_folder(spark) != shared_folder(spark)


def test_batch_run(spark, postings, parts, tmp_path):
    source, out, page = (str(tmp_path / name) for name in ("in", "out", "page"))
    postings.write.parquet(source)
    top = run_match(spark, source, parts, out, report_path=page, ordered=True, staging_path=str(tmp_path / "stage"))
    written = spark.read.parquet(out)
    assert written.count() == 60 and "job_description" not in written.columns
    assert as_rows(top.select(*written.columns)) == as_rows(top_matches(written))
    assert set(postings.columns) <= set(top.columns)
    assert not list((tmp_path / "stage").iterdir())
    assert as_rows(written) == as_rows(
        score_postings(postings, parts.select("profile_id", "text")).select(*written.columns)
    )
    html = "\n".join(r.value for r in spark.read.text(f"{page}/profile_id=1").collect())
    assert html.count("<tr><td>") == 10 and "</a>" in html
    assert spark.read.parquet(source).count() == 60


def test_no_profile_pushes_another_out(spark, postings, parts, tmp_path):
    postings.write.parquet(str(tmp_path / "in"))
    both = parts.unionAll(spark.createDataFrame([(2, 0, "pastry chef in a bakery")], parts.schema))
    top = run_match(spark, str(tmp_path / "in"), both, str(tmp_path / "out"), report_path=str(tmp_path / "page"))
    ranks = sorted((r.profile_id, r["rank"]) for r in top.collect())
    assert ranks == [(p, k) for p in (1, 2) for k in range(1, 11)]
    for p in (1, 2):
        assert "<tr><td>" in spark.read.text(str(tmp_path / f"page/profile_id={p}")).first().value
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120


def test_a_run_selects_and_skips_profiles_without_text(spark, postings, parts, tmp_path):
    timed = postings.withColumn("location", F.when(F.col("posting_id") % 2 == 0, "Here").otherwise("There")).withColumn(
        "posted_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(posting_id))"))
    timed.write.parquet(str(tmp_path / "in"))
    options = MatchOptions(keyword="airflow", location="here", as_of=datetime(2024, 1, 2, 20))
    empty = parts.unionAll(spark.createDataFrame([(3, 0, " ")], parts.schema))
    arguments = (spark, str(tmp_path / "in"), empty, str(tmp_path / "out"), options)
    with pytest.raises(Exception, match="no readable text in profile 3"):
        run_match(*arguments)
    run_match(*arguments, unreadable_path=str(tmp_path / "bad"))
    ids = {r.posting_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ids == {i for i in range(60) if i % 2 == 0 and i >= 20 and i % 3}
    assert [r.profile_id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [3]


def test_a_run_by_key(spark, postings, parts, tmp_path):
    postings.withColumn("search", F.col("posting_id") % 3).write.parquet(str(tmp_path / "in"))
    keyed = parts.withColumn("search", F.lit(1).cast("long"))
    run_match(spark, str(tmp_path / "in"), keyed, str(tmp_path / "out"), key="search")
    assert {r.posting_id % 3 for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}


def test_display_table_through_csv(spark, postings, parts, tmp_path):
    scored = score_postings(postings, parts.select("profile_id", "text")).select("posting_id", "profile_id", *SCORE_COLUMNS)
    path = str(tmp_path / "d")
    write_display(scored, postings.withColumn("location", F.lit("x")), path, ordered=True)
    back = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    assert back.columns[:4] == ["Serial Number", "Job Title", "Job Link", "Job Description"]
    assert back.count() == 60 and {"location", "ATS Score", "Missing Skills"} <= set(back.columns)
    write_scored(scored, str(tmp_path / "c"), "csv", header="true")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 60


def test_staging_needs_a_folder_and_goes(spark, tmp_path):
    with pytest.raises(ValueError):
        with staging(spark, str(tmp_path)) as stage:
            assert stage(spark.range(3)).count() == 3
            raise ValueError
    assert not list(tmp_path.iterdir())


def exchanged_rows(df):
    """Rows that each exchange of an executed plan wrote."""
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        elif name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return found


def test_rows_sent_to_a_ranking_are_few(spark):
    df = spark.range(4000).repartition(8).selectExpr(
        "id AS posting_id", "id % 2 AS profile_id", "double(id * 7919 % 4001) AS ats_score")
    top = top_per_profile(df, 5)
    assert len(top.collect()) == 10
    spread, *ranking = sorted(exchanged_rows(top), reverse=True)
    # From each of eight tasks five rows of each of two profiles, at most.
    assert spread == 4000 and ranking and max(ranking) <= 8 * 5 * 2


def moved_columns(df):
    """Columns that an exchange or a sort of the plan carries."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = re.findall(r"\(\d+\) (?:Exchange|Sort|SortAggregate)\b[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", text)
    return {re.sub(r"#.*", "", name) for part in parts for name in part.split(", ")}


def test_top_rows_move_no_texts(spark, postings, parts, tmp_path):
    source = str(tmp_path / "in")
    twice = postings.unionAll(postings.where("posting_id % 5 = 1").withColumn("job_title", F.lit("again")))
    twice.write.parquet(source)
    top = run_match(spark, source, parts, str(tmp_path / "out"))
    moved = moved_columns(top)
    assert "ats_score" in moved and "posting_id" in moved
    assert "job_description" not in moved
    rows = top.collect()
    assert len(rows) == 10 and all(r.job_description for r in rows)


def test_a_posting_listed_twice_shows_the_same_row_in_any_order(spark, postings, parts):
    other = postings.where("posting_id < 9").withColumns(
        {"job_title": F.lit("other"), "job_description": F.concat("job_description", F.lit(" more"))})
    scored = score_postings(postings, parts.select("profile_id", "text")).select("posting_id", "profile_id", *SCORE_COLUMNS)
    shown = [
        as_rows(with_postings(scored, both.repartition(n, "job_title"), few=few))
        for both, n in ((postings.unionAll(other), 1), (other.unionAll(postings), 5)) for few in (False, True)]
    assert len(shown[0]) == 60 and all(x == shown[0] for x in shown)


def test_writers_at_once_keep_their_tables_apart(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    for turn in range(4):
        path = str(tmp_path / f"t{turn}.parquet")
        with ThreadPoolExecutor(4) as pool:
            paths = list(pool.map(lambda n: write_without_clobbering(spark.range(n), path), range(1000, 1004)))
        assert len(set(paths)) == 4 and path in paths
        assert [spark.read.parquet(p).count() for p in paths] == list(range(1000, 1004))


def test_a_closed_folder_stops_the_writer_with_its_reason(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    with pytest.raises(Exception):
        write_without_clobbering(spark.range(1), str(tmp_path / "file" / "t.parquet"))


def test_written_table_is_ordered(spark, postings, parts, tmp_path):
    scored = score_postings(postings, parts.select("profile_id", "text"))
    write_scored(scored, str(tmp_path / "o"), "json", ordered=True)
    files = sorted((tmp_path / "o").glob("part-*.json"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    import json

    scores = [json.loads(line)["ats_score"] for line in lines]
    assert len(scores) == 60 and scores == sorted(scores, reverse=True)


def test_write_moves_aside_when_the_path_is_taken(spark, tmp_path):
    path, at = str(tmp_path / "t.parquet"), datetime(2024, 5, 6, 7, 8, 9)
    first = write_without_clobbering(spark.range(3), path)
    second = write_without_clobbering(spark.range(4), path, at=at)
    assert first == path and second == str(tmp_path / "t_20240506_070809.parquet")
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 4
    third = write_without_clobbering(spark.range(5), path, at=at)
    assert third == str(tmp_path / "t_20240506_070809_1.parquet") and spark.read.parquet(third).count() == 5
    assert stamped("s3a://b/x/y.csv", at) == "s3a://b/x/y_20240506_070809.csv"
    with pytest.raises(Exception):
        write_without_clobbering(spark.range(1), path, "no-such-format")


def test_report(spark):
    def page(rows):
        top = spark.createDataFrame(
            rows, "posting_id long, profile_id long, job_title string, job_link string, "
            "ats_score double, matched_skills array<string>, recommendation string",
        )
        return report.report(top).first().html

    linked = page([(1, 1, "Cut & Sew", "https://h/o/9041?x=1&y=2", 61.25, ["linux", "airflow"], "Go on.")])
    assert '<a href="https://h/o/9041?x=1&amp;y=2">Cut &amp; Sew</a>' in linked
    assert "<td>61.25%</td><td>linux, airflow</td>" in linked
    for link in ("", "  ", None, "javascript:alert(1)"):
        plain = page([(1, 1, "A", link, 7.0, [], "x")])
        assert "<a href=" not in plain and "<td>A</td>" in plain
    assert "No jobs were available for scoring." in page([])
    many = page([(i, 1, f"T{i}", "", float(i), [], "x") for i in range(5)])
    assert many.index("T4") < many.index("T3") < many.index("T0")


def test_incremental_equals_batch_and_reruns_change_nothing(spark, postings, parts, tmp_path):
    source, out, memory = (str(tmp_path / name) for name in ("in", "out", "memory"))
    profiles = parts.select("profile_id", "text")

    def run():
        score_new_files(spark, source, profiles, out, memory, max_files=1).awaitTermination()

    postings.where("posting_id < 30").coalesce(1).write.parquet(source)
    run()
    postings.where("posting_id >= 30").repartition(2, "posting_id").write.mode("append").parquet(source)
    run()
    postings.where("posting_id < 5").coalesce(1).write.mode("append").parquet(source)  # landed before
    run()
    expected = score_postings(postings, profiles, MatchOptions()).drop("position", "job_description")
    got = scored_so_far(spark, out)
    assert got.select("batch_id").distinct().count() == 3 and got.count() == 60
    assert as_rows(got.select(*expected.columns)) == as_rows(expected)
    run()
    assert scored_so_far(spark, out).count() == 60
    # Nothing of the earlier batches is read again: a run goes on without them.
    (tmp_path / "out").rename(tmp_path / "moved")
    postings.where("posting_id < 7").withColumn("posting_id", F.col("posting_id") + 58).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.posting_id for r in scored_so_far(spark, out).collect()) == [60, 61, 62, 63, 64]
    assert list((tmp_path / "memory" / "state").rglob("*.zip"))


def test_a_posting_counts_anew_after_its_retention(spark, postings, parts, tmp_path):
    source, out, memory = (str(tmp_path / name) for name in ("in", "out", "memory"))

    def landed(ids):
        postings.where(F.col("posting_id").isin(ids)).coalesce(1).write.mode("append").parquet(source)
        score_new_files(
            spark, source, parts.select("profile_id", "text"), out, memory, retention="2 seconds").awaitTermination()
        return sorted(r.posting_id for r in scored_so_far(spark, out).collect())

    assert landed([1, 2]) == [1, 2]
    time.sleep(5)
    assert landed([3]) == [1, 2, 3]  # the batch's time moves on, and with it what is forgotten
    assert landed([1, 3])[:2] == [1, 1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_has_no_exchange_and_ranking_no_full_sort(spark, postings, parts, tmp_path):
    path = str(tmp_path / "p")
    postings.write.parquet(path)
    scored = score_postings(spark.read.parquet(path), parts.select("profile_id", "text"))
    main = plan(scored).split("Subquery")[0] + plan(scored.drop("job_description"))
    assert "Join" not in main and "BatchEvalPython" not in main and "ArrowEval" not in main
    assert "TakeOrderedAndProject" in plan(top_matches(scored))
    lines = [line for line in plan(scored).splitlines() if "Exchange" in line and "SinglePartition" not in line]
    assert lines == []
    narrow = plan(scored.select("posting_id", "skill_match"))
    assert "job_link" not in narrow.split("ReadSchema")[1]


def test_keywords_are_computed_once(spark, postings, parts):
    scored = score_postings(postings, parts.select("profile_id", "text"))
    best = plan(top_matches(scored).select("posting_id", F.size("matched_skills")))
    assert best.count("regexp_extract_all(_text") <= 4


def test_landed_files_grow_with_the_table(spark, monkeypatch, tmp_path):
    """No task writes or reads a third of a table, and each posting counts once."""
    spark.range(90).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "s", -1.0)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(
        f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(queries, "LANDED_BYTES", 1_000)
    folder = queries._landed(spark, str(tmp_path))
    assert len(spark.read.parquet(f"{folder}/landed").inputFiles()) > 4
    got = scored_so_far(spark, f"{folder}/scored")
    assert sorted(r[0] for r in got.select("posting_id").collect()) == [*range(90), 1_000_000_001]
