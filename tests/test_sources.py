import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from postmatch.sources import descriptions, html, payloads, search
from postmatch.sources.postings import MissingColumn, conform, read_postings, spread
from postmatch.sources.profiles import assemble, readable, split_unreadable

# --- posting tables ---------------------------------------------------------


def test_missing_path_and_columns(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_postings(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(MissingColumn, match="Job Description"):
        conform(spark.createDataFrame([(1, "t")], "posting_id long, `Job Title` string"))


def test_a_sheet_without_ids_gets_stable_ones(spark):
    sheet = spark.createDataFrame(
        [("1", "t", "l", "d"), ("2", "t", "l", "e"), ("3", "t", "l", "d")],
        "`Serial Number` string, `Job Title` string, `Job Link` string, `Job Description` string")
    ids = [r.posting_id for r in conform(sheet).orderBy("position").collect()]
    assert ids[0] == ids[2] != ids[1] and None not in ids


def test_spreading_runs_no_job_and_leaves_large_inputs(spark, monkeypatch):
    small = spread(spark.range(10).withColumnRenamed("id", "posting_id"))
    assert small.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    grouped = spark.range(10**9).groupBy((F.col("id") % 7).alias("posting_id")).count()
    start = time.time()
    spread(grouped)
    assert time.time() - start < 5


def test_headers_and_optional_columns(spark):
    table = spark.createDataFrame([(1, "d")], "posting_id long, `Job Description` string")
    row = conform(table).first()
    assert (row.job_description, row.job_title, row.job_link) == ("d", "", "")


@pytest.mark.parametrize("format", ["csv", "json", "parquet"])
def test_formats_round_trip(spark, tmp_path, format):
    table = spark.createDataFrame(
        [(1, 1, "t, \"x\"", "l", "N/A"), (2, 2, "u", None, None)],
        "posting_id long, position int, job_title string, job_link string, job_description string",
    )
    path = str(tmp_path / format)
    options = {"header": "true", "escape": '"'} if format == "csv" else {}
    table.write.format(format).options(**options).save(path)
    back = read_postings(spark, path, format, **options)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))


# --- profiles ---------------------------------------------------------------


def test_parts_join_in_order_across_chunks(spark):
    numbers = list(range(-5, 3000))
    random.Random(1).shuffle(numbers)
    parts = spark.createDataFrame(
        [(1, n, f"p{n}") for n in numbers] + [(2, 1, None), (2, 0, " x ")],
        "profile_id long, part_no int, text string",
    ).repartition(5)
    found = {r.profile_id: r.text for r in assemble(parts).collect()}
    assert found[1] == "\n".join(f"p{n}" for n in sorted(numbers))
    assert found[2] == "x"


def test_unreadable_profiles(spark):
    parts = spark.createDataFrame([(1, 0, "a"), (2, 0, " \n")], "profile_id long, part_no int, text string")
    good, bad = split_unreadable(assemble(parts))
    assert [r.profile_id for r in good.collect()] == [1]
    assert [r.profile_id for r in bad.collect()] == [2]
    with pytest.raises(Exception, match="no readable text in profile 2"):
        readable(assemble(parts)).collect()
    with pytest.raises(Exception, match="no readable text in profile 2"):
        readable(assemble(parts)).select("profile_id").collect()


# --- HTML -------------------------------------------------------------------


@pytest.mark.parametrize(
    "markup, expected",
    [
        ("<p>a<b>b</b></p>c", "a b c"),
        ("a<script>x<y</script>b<!-- no -->c<style>p{}</style>", "a b c"),
        ("a</b> <i>b", "a   b"),
        ("&lt;b&gt; &amp;amp; &#233;&#x1F600;&#X41; &nbsp;&quot;&middot;", "<b> &amp; é😀A \xa0\"·"),
        ("", ""),
    ],
)
def test_markup_text(one, markup, expected):
    assert one(html.markup_text(F.col("x")), x=markup) == expected


def test_container_by_class_and_absence(one):
    page = '<div class="x">no</div><div id="q" class="a text__markup b"><p>yes</p></div>'
    assert one(html.container_text(F.col("x"), html.Element("div", "text__markup")), x=page) == "yes"
    assert one(html.container_text(F.col("x"), html.Element("div", "markup")), x=page) == ""
    assert one(html.container_text(F.col("x"), html.Element("article")), x=page) == ""
    known = '<div class="show-more-less-html__markup clamp">a<br>b</div>'
    assert one(html.container_text(F.col("x")), x=known) == "a b"


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<section class="show-more-less-html__markup">a</section>b', "a"),
        ('<div class="show-more-less-html__markup"><div>a</div><p>b</p></div>c', "a b"),
        ("<DIV CLASS=show-more-less-html__markup>k<br>l</DIV>m", "k l"),
        ('<div class="z show-more-less-html__markup">open<div>in</div>rest', "open in rest"),
        ('<p class="show-more-less-html__markup"><b title="a>b">x</b><!-- </p> --> y</p>z', "x  y"),
        ("<script>'<div class=\"show-more-less-html__markup\">'</script>none", ""),
    ],
)
def test_containers_are_whole_and_found_by_class(one, page, expected):
    assert one(html.container_text(F.col("x")), x=page) == expected


@pytest.mark.parametrize(
    "page, scope, expected",
    [
        ("<ul><li>A<li>B</ul>", None, ["<li>A", "<li>B"]),
        ("<UL><LI>A</LI></UL>", None, ["<LI>A</LI>"]),
        ("<ul><li>Job <ul><li>x</li></ul> City</li></ul>", None,
         ["<li>Job <ul><li>x</li></ul> City</li>", "<li>x</li>"]),
        ("<ul><li>nav</ul><main id=main-content><p><ul><li>one</li><li>two</ul></main><ul><li>no",
         "main-content", ["<li>one</li>", "<li>two"]),
        ("<ol><li>x</ol><ul><li>open", None, ["<li>open"]),
        ("<main id='main-content'><ul><li>a</main>b</li>", "main-content", ["<li>a"]),
        ("</ul></li><ul><li>q<p>r</ul>", None, ["<li>q<p>r"]),
        ("<li>in no list</li>", None, []),
    ],
)
def test_cards(one, page, scope, expected):
    assert one(html.cards(F.col("x"), scope), x=page) == expected


def test_inline_elements_do_not_part_words(one):
    card = "<li>Soft<b>ware</b><div>x</div>y<SPAN>z</SPAN>&amp;<br>w</li>"
    assert one(html.card_text(F.col("x")), x=card) == "Software x yz& w"


def test_container_of_no_page(one):
    assert one(html.container_text(F.col("x"), html.Element("article")), x=None) == ""


@pytest.mark.parametrize(
    "card, expected",
    [
        ('<li><a href="/x">1</a><a href="/jobs/view/7?a=1&amp;b=2">2</a></li>', "https://h.example/jobs/view/7?a=1&b=2"),
        ("<li><a href='/x'>1</a><a class='base-card__full-link z' href='y'>2</a></li>", "https://h.example/p/y"),
        ('<li><a name="n">0</a><a href=" //o.example/z ">1</a></li>', "https://o.example/z"),
        ('<li><a href="?q=1">1</a></li>', "https://h.example/p/q?q=1"),
        ('<li><a href="../x/./y/../z?u=/../">1</a></li>', "https://h.example/x/z?u=/../"),
        ('<li><a href="/a/b/..">1</a></li>', "https://h.example/a/"),
        ('<li><a href="/../../a">1</a></li>', "https://h.example/a"),
        ('<li><a href="#f">1</a></li>', "https://h.example/p/q?w=1#f"),
        ('<li><a href="mailto:a@b">1</a></li>', "mailto:a@b"),
        ('<li><a href="/für dich">1</a></li>', "https://h.example/f%C3%BCr%20dich"),
        ("<li>none</li>", ""),
        ("<li><a href=/jobs/view/1>1</a></li>", "https://h.example/jobs/view/1"),
        ("<li><A HREF=/x class=base-card__full-link>1</A><a href='/y'>2</a></li>", "https://h.example/x"),
    ],
)
def test_card_link(one, card, expected):
    link = html.card_link(F.col("card"), F.col("url"))
    assert one(link, card=card, url="https://h.example/p/q?w=1") == expected


@pytest.mark.parametrize(
    "card, link, expected",
    [
        ('<li class="c" data-job-id="12"><a data-job-id="34">', "/jobs/view/56", "12"),
        ('<li data-job-id=""><a data-job-id=" 34 ">', "/jobs/view/56", "34"),
        ('<li><a data-job-id="">', "/jobs/view/56", ""),
        ("<LI DATA-JOB-ID=78>", "/jobs/view/56", "78"),
        ("<li><a>", "https://h/jobs/view/56?x", "56"),
        ("<li><a>", "https://h/jobs/56", ""),
    ],
)
def test_card_id(one, card, link, expected):
    assert one(html.card_id(F.col("card"), F.col("link")), card=card, link=link) == expected


def test_cards_are_capped_numbered_and_counted(spark):
    page = "<ul>" + "".join(f"<li><b>T {i}</b>\n<i>Place</i></li>" for i in range(130)) + "</ul>"
    pages = spark.createDataFrame(
        [(1, "http://h/a", page), (2, "http://h/b", "<p>none</p>"), (3, "http://h/c", None)],
        "page_id long, url string, html string",
    )
    whole = search.page_cards(pages, carry=["page_id"], scope=None)
    assert whole.count() == 130
    cards = search.card_rows(search.page_cards(pages, 100, carry=["page_id"], scope=None))
    found = cards.orderBy("page_id", "position").collect()
    assert [r.position for r in found] == list(range(1, 101))
    assert {r.total_cards for r in found} == {130}
    assert (found[0].job_title, found[0].job_link, found[0].job_id) == ("T 0 Place", "", "")


# --- search -----------------------------------------------------------------


def test_search_url(one):
    url = search.search_url(F.col("k"), F.col("p"), "s?k=%s&l=%s&t=%d")
    assert one(url, k="QA & C++ ~*", p="São Paulo/x") == (
        "s?k=QA%20%26%20C%2B%2B%20~%2A&l=S%C3%A3o%20Paulo/x&t=86400"
    )


def test_matches_search(one):
    def match(title, text, where, **wanted):
        wanted = {"keyword": "", "place": ""} | wanted
        return one(search.matches_search(F.col("t"), F.col("d"), F.col("p"), **wanted), t=title, d=text, p=where)

    assert match("QA", None, "Here", keyword="qa", place="HERE") is True
    assert match("QA", "engineer", "Here", keyword="Engineer QA") is True
    assert match("QA", "", "Here", keyword="qa lead") is False
    assert match("QA", "", "There", place="here") is False
    assert match(None, None, None) is True


def test_recency_bound_is_inclusive_and_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    times = ["2024-01-01 23:59:59", "2024-01-02 00:00:00", "2024-01-02 20:00:00"]
    spark.createDataFrame([(t,) for t in times], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("ts")
    ).write.parquet(path)
    recent = spark.read.parquet(path).where(
        search.posted_recently(F.col("ts"), datetime(2024, 1, 3))
    )
    assert recent.count() == 2
    assert "GreaterThanOrEqual(ts" in recent._jdf.queryExecution().executedPlan().toString()


def test_recency_with_a_zone(spark):
    times = spark.createDataFrame([("2024-01-02 01:29:59",), ("2024-01-02 01:45:00",)], "t string")
    as_of = datetime(2024, 1, 3, 7, tzinfo=timezone(timedelta(hours=5, minutes=30)))
    for kind in ("timestamp_ntz", "timestamp"):
        found = times.select(F.col("t").cast(kind).alias("ts")).where(search.posted_recently(F.col("ts"), as_of))
        assert [str(r.ts) for r in found.collect()] == ["2024-01-02 01:45:00"]


def test_first_rows(spark):
    df = spark.range(500).select((499 - F.col("id")).alias("position"))
    got = search.first_rows(df, 100, "position").orderBy("position").collect()
    assert [(r.position, r.serial_number) for r in got] == [(i, i + 1) for i in range(100)]


def test_blocked(spark):
    pages = spark.createDataFrame([("http://a/authwall?x",), ("http://a/ok",), (None,)], "url string")
    usable, shut = search.split_blocked(pages)
    assert usable.count() == 2 and shut.count() == 1
    with pytest.raises(Exception, match="search was blocked"):
        search.fail_if_blocked(pages).collect()
    paged = pages.withColumn("page_id", F.lit(1))
    with pytest.raises(Exception, match="search was blocked"):
        search.fail_if_blocked(paged).select("page_id").collect()
    assert search.fail_if_blocked(usable).count() == 2


# --- payloads and descriptions ----------------------------------------------


@pytest.mark.parametrize(
    "payload, text, error, status",
    [
        ('{"description": {"text": " hi "}}', "hi", None, None),
        ('{"description": {}}', "", None, None),
        ('{"error": "HTTP 429"}', "", "HTTP 429", 429),
        ('{"error": "network down"}', "", "network down", None),
        ("not json", "", None, None),
        (None, "", None, None),
    ],
)
def test_payload(one, payload, text, error, status):
    assert one(payloads.json_text(F.col("x")), x=payload) == text
    assert one(payloads.json_error(F.col("x")), x=payload) == error
    assert one(payloads.json_status(F.col("x")), x=payload) == status


CARDS = [
    (1, "a", "ui1"), (2, "b", "ui2"), (3, "c", None), (4, "", "ui4"), (5, None, ""),
    (6, "d", "ui6"), (7, "e", "ui7"), (8, "a", "ui8"), (9, "z", "ui9"),
    (10, "f", "ui"), (11, "g", "ui"), (12, "h", "ui"),
]
FETCHED = [
    ("a", "page", 200, "page a"), ("a", "json", 200, "json a"),
    ("b", "page", 429, None), ("b", "json", 200, "json b"),
    ("c", "page", 200, ""), ("c", "json", 200, "json c"),
    ("d", "page", 500, "error page"), ("d", "json", 403, None),
    ("e", "page", None, None), ("e", "json", None, "json e"),
    ("", "page", 200, "nobody's"),
    ("f", "page", 429, None), ("f", "page", 200, "good page text"),
    ("g", "page", 200, "kept"), ("g", "page", 429, None),
    ("h", "page", 200, "b text"), ("h", "page", 200, "a text"), ("h", "page", 500, "c text"),
]


def test_the_latest_attempt_counts_where_times_are_known(spark):
    fetched = spark.createDataFrame(
        [("a", "page", 200, "old", 1), ("a", "page", 429, None, 2), ("b", "page", 429, None, 1), ("b", "page", 200, "new", 2)],
        "job_id string, source string, status int, text string, attempted_at int")
    cards = spark.createDataFrame([(1, "a", "ui"), (2, "b", "ui")], "posting_id long, job_id string, ui_text string")
    got = descriptions.attach_descriptions(cards, fetched).orderBy("posting_id").collect()
    assert [r.job_description for r in got] == ["ui", "new"]


def test_no_text_is_sorted_to_choose_a_description(spark):
    cards = spark.createDataFrame(CARDS, "posting_id long, job_id string, ui_text string")
    fetched = spark.createDataFrame(FETCHED, "job_id string, source string, status int, text string")
    plan = descriptions.attach_descriptions(cards, fetched)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_description_source(spark):
    cards = spark.createDataFrame(CARDS, "posting_id long, job_id string, ui_text string")
    fetched = spark.createDataFrame(FETCHED, "job_id string, source string, status int, text string")
    got = descriptions.attach_descriptions(cards, fetched).orderBy("posting_id").collect()
    assert [(r.posting_id, r.job_description, r.description_source) for r in got] == [
        (1, "page a", "page"), (2, "ui2", "ui"), (3, "json c", "json"), (4, "ui4", "ui"),
        (5, "", "none"), (6, "ui6", "ui"), (7, "json e", "json"), (8, "page a", "page"),
        (9, "ui9", "ui"), (10, "good page text", "page"), (11, "kept", "page"), (12, "a text", "page"),
    ]


@pytest.mark.parametrize("markup, expected", [
    ("<p>x", "https://h.org/a/b"), ("<base href=/c/d>", "https://h.org/c/d"), ("<BASE target=x HREF='../up/'><base href=late>", "https://h.org/up/"),
    ("<!-- <base href=/no> --><script>'<base href=/no>'</script>", "https://h.org/a/b"), ("<base href=' '>", "https://h.org/a/b"),
    ('<base href="//o.net/x?a=1&amp;b">', "https://o.net/x?a=1&b"), ("<basefont href=/no>", "https://h.org/a/b"), ("", "https://h.org/a/b"),
])
def test_base_of_a_page(one, markup, expected):
    assert one(html.base_url(F.col("m"), F.col("u")), m=markup, u="https://h.org/a/b") == expected


def test_base_of_no_page(one):
    assert one(html.base_url(F.col("m"), F.col("u")), m=None, u="https://h.org/a") == "https://h.org/a"
