"""One registered query per operator, over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
import tempfile
from datetime import datetime, timedelta, timezone
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.functions import numbers, text
from postmatch.operators import features, keywords, pruned, rank, skills, vocabulary
from postmatch.operators.pairing import every_pair, keyed_pairs
from postmatch.operators.score import (
    posting_features,
    profile_features,
    report_columns,
    score_pairs,
    score_postings,
)
from postmatch.operators.semantic import HashingEncoder, StoredVectors
from postmatch.options import MatchOptions
from postmatch.plans.batch import run_match
from postmatch.plans.ingest import postings_from_pages
from postmatch.sinks import report, tables as sink
from postmatch.sources import descriptions, html, payloads, search
from postmatch.sources.pages import read_pages
from postmatch.sources.postings import conform, read_postings, spread
from postmatch.sources.profiles import assemble
from postmatch.streaming.incremental import score_new_files, scored_so_far
from postmatch_checks import tables

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = datetime(2024, 1, 31)
PAGE_CAP = 100
#: Text bytes of a landed file, about.
LANDED_BYTES = 64 * 1024 * 1024
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share; one of its own where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        return sink.shared_folder(spark, tempfile.mkdtemp(prefix="postmatch-"))
    return sink.shared_folder(spark)


def _options() -> MatchOptions:
    return MatchOptions()


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_features(tables.postings(spark, sf_dir), _options(), HashingEncoder())


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = profile_features(tables.profiles(spark), _options(), HashingEncoder())
    return every_pair(_features(spark, sf_dir), right)


def _scored(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    right = tables.profile(spark) if one else tables.profiles(spark)
    return score_postings(tables.postings(spark, sf_dir), right, _options())


def _joined(column: str) -> Column:
    return text.comma_list(F.col(column)).alias(column)


def _flat(scored: DataFrame, *carry: str) -> DataFrame:
    return scored.select(
        *carry,
        "posting_id", "profile_id", "ats_score", "semantic_match", "skill_match",
        "keyword_match", "title_match", "experience_match", "education_bonus",
        _joined("matched_skills"), _joined("missing_skills"), "recommendation",
    )


# --- sources ---------------------------------------------------------------


@query
def posting_scan(spark, sf_dir):
    """Read a table that has other names and no title or link column."""
    found = read_postings(
        spark, f"{sf_dir}/documents.parquet",
        names={"posting_id": "doc_id", "job_description": "text"},
    )
    return found.select(
        "posting_id", "job_title", "job_link", F.md5("job_description").alias("text_md5")
    )


@query
def profile_text(spark, sf_dir):
    return assemble(
        tables.table(spark, sf_dir, "conversations"), profile="conv_id", part="turn"
    )


@query
def html_text(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", html.container_text(F.col("html"), html.Element("article")).alias("body")
    )


@query
def class_container_text(spark, sf_dir):
    """The container by class, whatever its tag, with an element of its name inside."""
    return tables.derive(spark, sf_dir, tables.CLASS_PAGES).select(
        "page_id", html.container_text(F.col("html")).alias("body")
    )


@query
def sheet_scan(spark, sf_dir):
    """A table under display headers and without ids: equal postings share an id."""
    sheet = tables.table(spark, sf_dir, "documents").select(
        F.lit("1").alias("Serial Number"), F.lit("t").alias("Job Title"),
        F.lit("").alias("Job Link"), F.col("text").alias("Job Description"))
    return conform(sheet).groupBy(F.md5("job_description").alias("text_md5")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("posting_id").alias("n_ids"))


@query
def json_payload(spark, sf_dir):
    return tables.derive(spark, sf_dir, tables.PAYLOADS).select(
        "event_id",
        payloads.json_text(F.col("payload")).alias("description"),
        payloads.json_error(F.col("payload")).alias("error"),
        payloads.json_status(F.col("payload")).alias("status"),
        payloads.json_text(F.col("props"), "$.k").alias("k"),
    )


# --- search and extraction -------------------------------------------------


@query
def search_url(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    keyword = F.concat_ws(" & ", "p_name", "p_type")
    place = F.concat_ws("/", "p_brand", F.lit("São*Paulo~"))
    return part.select("p_partkey", search.search_url(keyword, place).alias("url"))


@query
def keyword_filter(spark, sf_dir):
    found = tables.derive(spark, sf_dir, tables.POSTINGS)
    return found.where(
        search.matches_search(
            F.col("job_title"), F.col("job_description"), F.col("location"),
            keyword="Automation Engineer", place="EN",
        )
    ).select("posting_id", "location")


@query
def recency(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    return events.where(search.posted_recently(F.col("ts"), AS_OF)).select(
        "event_id", "event_type", "value"
    )


@query
def recency_zone(spark, sf_dir):
    """A bound that names its zone, as a schedule abroad does."""
    as_of = datetime(2024, 1, 31, 7, tzinfo=timezone(timedelta(hours=5, minutes=30)))
    events = tables.table(spark, sf_dir, "events")
    return events.where(search.posted_recently(F.col("ts"), as_of)).select("event_id", "event_type", "value")


@query
def first_100(spark, sf_dir):
    """Cap and serial number over one result list."""
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "url")
    return search.first_rows(pages, PAGE_CAP, "page_id")


@query
def first_per_search(spark, sf_dir):
    """Cap and serial number over many result lists in one table."""
    found = tables.table(spark, sf_dir, "documents").select("lang", "doc_id")
    return search.first_rows_per_search(found, PAGE_CAP, "lang", "doc_id")


@query
def total_cards(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(html.cards(F.col("html"), None)).alias("total_cards"))


def _cards(spark, sf_dir):
    pages = spread(tables.derive(spark, sf_dir, tables.CARD_PAGES), "page_id")
    return search.card_rows(search.page_cards(pages, carry=["page_id"]))


@query
def card_text(spark, sf_dir):
    return _cards(spark, sf_dir).select("page_id", "position", "total_cards", "job_title")


@query
def page_link(spark, sf_dir):
    return _cards(spark, sf_dir).select("page_id", "position", "job_link")


@query
def page_base_link(spark, sf_dir):
    """Links of pages that say what their links are relative to."""
    pages = spread(tables.derive(spark, sf_dir, tables.BASED_PAGES), "page_id")
    found = search.card_rows(search.page_cards(pages, carry=["page_id"]))
    return found.select("page_id", "position", "job_link")


@query
def page_id(spark, sf_dir):
    return _cards(spark, sf_dir).select("page_id", "position", "job_id")


@query
def source_fallback(spark, sf_dir):
    chosen = descriptions.attach_descriptions(
        tables.derive(spark, sf_dir, tables.CARDS_WITH_IDS),
        tables.derive(spark, sf_dir, tables.FETCHED),
    )
    return chosen.select(
        "posting_id", "description_source", F.md5("job_description").alias("text_md5")
    )


@query
def blocked(spark, sf_dir):
    _, shut = search.split_blocked(tables.table(spark, sf_dir, "pages"), "spam-farm")
    return shut.select("page_id", "url")


@query
def not_blocked(spark, sf_dir):
    usable, _ = search.split_blocked(tables.table(spark, sf_dir, "pages"), "spam-farm")
    return usable.select("page_id", "url")


# --- text scalars ----------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    return tables.postings(spark, sf_dir).select(
        "posting_id",
        text.normalise(F.col("job_description")).alias("normal"),
        text.squeeze(F.col("job_title")).alias("title_on_one_line"),
    )


def _words(spark, sf_dir):
    found = tables.postings(spark, sf_dir)
    return found.select(
        "posting_id", text.tokens(text.normalise(F.col("job_description"))).alias("words")
    )


@query
def tokens(spark, sf_dir):
    """Token sequence of each posting, and how many there are."""
    return _words(spark, sf_dir).select(
        "posting_id",
        F.size("words").alias("n"),
        F.md5(F.array_join("words", " ")).alias("words_md5"),
    )


@query
def token_filter(spark, sf_dir):
    kept = text.content_tokens(F.col("words"), _options().stop_list())
    return _words(spark, sf_dir).select(
        "posting_id", F.posexplode_outer(kept).alias("position", "token")
    ).where(F.col("token").isNotNull())


@query
def flag_parse(spark, sf_dir):
    return tables.derive(spark, sf_dir, tables.SETTINGS).select(
        "event_id",
        text.flag(F.col("setting")).alias("off_by_default"),
        text.flag(F.col("setting"), True).alias("on_by_default"),
    )


@query
def bounded_pct(spark, sf_dir):
    value = F.col("value")
    return tables.table(spark, sf_dir, "events").select(
        "event_id", numbers.bounded_percentage(value * 1.7 - 10).alias("pct")
    )


@query
def percentage(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "lineitem")
    part = F.col("l_linenumber") - 1
    return orders.select(
        "l_orderkey", "l_linenumber",
        numbers.percentage(part, F.col("l_quantity") - 1).alias("pct"),
    )


@query
def list_join(spark, sf_dir):
    return _words(spark, sf_dir).select(
        "posting_id", text.comma_list(F.col("words")).alias("joined")
    )


# --- skills ----------------------------------------------------------------


@query
def skill_extraction(spark, sf_dir):
    return _features(spark, sf_dir).select("posting_id", _joined("_skills")).withColumnRenamed(
        "_skills", "skills"
    )


@query
def skill_tokens(spark, sf_dir):
    """Skills that match whole tokens: "excellent" is no "excel"."""
    options = MatchOptions(match_mode="token")
    normal = text.normalise(F.col("job_description"))
    return tables.postings(spark, sf_dir).select(
        "posting_id", text.comma_list(skills.skills_in(normal, options)).alias("skills"))


def _vocabulary(spark, sf_dir, find):
    texts = spread(tables.texts_with_parts(spark, sf_dir), "id")
    found = find(texts, tables.derive(spark, sf_dir, tables.VOCABULARY), stage=sink.Stage(spark, _folder(spark)))
    return found.groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("terms")).select(
        "id", _joined("terms"))


@query
def large_vocabulary(spark, sf_dir):
    """Every document against a term per part, and some more."""
    return _vocabulary(spark, sf_dir, vocabulary.terms_in)


@query
def large_vocabulary_tokens(spark, sf_dir):
    """The same where terms have to match whole tokens."""
    return _vocabulary(spark, sf_dir, vocabulary.tokens_in)


def _skill_pairs(spark, sf_dir):
    theirs, ours = F.col("_skills"), F.col("profile.skills")
    return (
        _pairs(spark, sf_dir)
        .select("posting_id", "profile.profile_id", "_skills",
                skills.matched_skills(theirs, ours).alias("matched"),
                skills.missing_skills(theirs, ours).alias("missing"))
    )


@query
def skill_sets(spark, sf_dir):
    return _skill_pairs(spark, sf_dir).select(
        "posting_id", "profile_id", _joined("matched"), _joined("missing"),
        text.comma_list(skills.shown_missing(F.col("missing"), _options())).alias("shown"),
    )


@query
def skill_match(spark, sf_dir):
    return _skill_pairs(spark, sf_dir).select(
        "posting_id", "profile_id",
        skills.skill_match(F.col("matched"), F.col("_skills")).alias("skill_match"),
    )


# --- keywords --------------------------------------------------------------


@query
def term_freq(spark, sf_dir):
    kept = text.content_tokens(F.col("words"), _options().stop_list())
    counted = _words(spark, sf_dir).select(
        "posting_id", F.explode_outer(keywords.term_counts(kept)).alias("term")
    )
    return counted.where(F.col("term").isNotNull()).select("posting_id", "term.*")


@query
def boosted_terms(spark, sf_dir):
    """Every weighted keyword, before the cut."""
    terms = keywords.weighted_keywords(F.col("_words"), F.col("_skills"), in_batches=True)
    return (
        _features(spark, sf_dir)
        .select("posting_id", F.explode_outer(terms).alias("term"))
        .where(F.col("term").isNotNull())
        .select("posting_id", "term.token", "term.weight")
    )


@query
def top_keywords(spark, sf_dir):
    return (
        _features(spark, sf_dir)
        .select("posting_id", F.explode_outer("_keywords").alias("keyword"))
        .where(F.col("keyword").isNotNull())
        .select("posting_id", "keyword.*")
    )


@query
def keyword_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "posting_id", "profile.profile_id",
        keywords.keyword_match(
            F.col("profile.text"), F.col("_keywords"), F.col("_weight")
        ).alias("keyword_match"),
    )


# --- title, experience, education ------------------------------------------


@query
def title_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "posting_id", "profile.profile_id",
        features.title_match(F.col("profile.text"), F.col("_title_words")).alias("title_match"),
    )


@query
def max_years(spark, sf_dir):
    return _features(spark, sf_dir).select("posting_id", F.col("_years").alias("years"))


@query
def experience_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "posting_id", "profile.profile_id",
        features.experience_match(F.col("_years"), F.col("profile.years"))
        .alias("experience_match"),
    )


@query
def experience_override(spark, sf_dir):
    """The configured years replace what each profile says."""
    options = MatchOptions(experience_years=2.0)
    scored = score_postings(tables.postings(spark, sf_dir), tables.profiles(spark), options)
    return scored.select("posting_id", "profile_id", "experience_match")


@query
def required_education(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "posting_id", text.comma_list(F.col("_education")).alias("required")
    )


@query
def education_bonus(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "posting_id", "profile.profile_id",
        features.education_bonus(F.col("profile.text"), F.col("_education"))
        .alias("education_bonus"),
    )


# --- semantic --------------------------------------------------------------


@query
def text_embedding(spark, sf_dir):
    """Non-zero entries of the hashed term vector."""
    return (
        _features(spark, sf_dir)
        .select("posting_id", F.posexplode_outer("_vector").alias("bucket", "weight"))
        .where(F.col("weight") > 0)
        .select("posting_id", "bucket", F.col("weight").cast("double").alias("weight"))
    )


@query
def semantic_match(spark, sf_dir):
    return _scored(spark, sf_dir).select("posting_id", "profile_id", "semantic_match")


@query
def cosine_match(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings")
    chosen = vectors.where("vec_id = 0").select("embedding").scalar()
    return vectors.withColumn("_chosen", chosen).select(
        "vec_id",
        numbers.cosine_percentage(F.col("_chosen"), F.col("embedding")).alias("cosine"),
    )


@query
def stored_vectors(spark, sf_dir):
    """Scores on vectors computed elsewhere; postings without one get 0."""
    vectors = tables.table(spark, sf_dir, "embeddings")
    coded = tables.postings(spark, sf_dir).join(
        vectors.select(F.col("vec_id").alias("posting_id"), "embedding"), "posting_id", "left"
    )
    whose = tables.profiles(spark).join(
        F.broadcast(
            vectors.where("vec_id BETWEEN 1 AND 4").select(
                F.col("vec_id").alias("profile_id"), "embedding"
            )
        ),
        "profile_id", "left",
    )
    scored = score_postings(coded, whose, _options(), StoredVectors("embedding"))
    return scored.select("posting_id", "profile_id", "semantic_match", "ats_score")


# --- score -----------------------------------------------------------------


@query
def pairing(spark, sf_dir):
    return _pairs(spark, sf_dir).select("posting_id", "profile.profile_id")


@query
def pairing_by_key(spark, sf_dir):
    """Only the postings of a profile's own search."""
    searches = tables.profiles(spark).withColumn(
        "location", F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "none"])), F.col("profile_id").cast("int"))
    )
    pairs = keyed_pairs(tables.postings(spark, sf_dir), searches, "location")
    return pairs.select("posting_id", "profile.profile_id", "location")


@query
def pairing_many(spark, sf_dir):
    """A table of profiles in several blocks: each one's best postings."""
    chats = assemble(tables.table(spark, sf_dir, "conversations"), profile="conv_id", part="turn")
    right = chats.where("text != ''")
    scored = score_postings(
        tables.postings(spark, sf_dir), right, _options(), stage=sink.Stage(spark, _folder(spark)), max_profiles=32)
    return rank.top_per_profile(scored.select("profile_id", "posting_id", "ats_score"), 3)


@query
def no_description(spark, sf_dir):
    scored = _flat(_scored(spark, sf_dir))
    return scored.where(F.col("recommendation") == "No job description available for scoring.")


@query
def full_score(spark, sf_dir):
    return _flat(_scored(spark, sf_dir))


@query
def one_profile_score(spark, sf_dir):
    return _flat(_scored(spark, sf_dir, one=True))


@query
def recommendation(spark, sf_dir):
    """How often each advice is given to each profile."""
    return _scored(spark, sf_dir).groupBy("profile_id", "recommendation").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def score_columns(spark, sf_dir):
    """Display columns, as the written sheet shows them."""
    shown = report_columns(_scored(spark, sf_dir, one=True))
    return shown.withColumn("Job Description", F.md5("Job Description"))


# --- rank ------------------------------------------------------------------


@query
def total_sort(spark, sf_dir):
    return rank.by_score(_scored(spark, sf_dir, one=True)).select("posting_id", "ats_score")


@query
def top10(spark, sf_dir):
    return _flat(rank.top_matches(_scored(spark, sf_dir, one=True)))


@query
def top_per_profile(spark, sf_dir):
    thin = _scored(spark, sf_dir).select("profile_id", "posting_id", "ats_score")
    return rank.top_per_profile(thin)


@query
def top_per_profile_pruned(spark, sf_dir):
    """The best ten of each of many profiles, of which few pairs are scored."""
    stage = sink.Stage(spark, _folder(spark))
    return pruned.pruned_top(tables.postings(spark, sf_dir), _writers(spark, sf_dir), _options(), stage=stage)


def _writers(spark, sf_dir):
    """Chats as profiles, each with what its writer can do."""
    chats = assemble(tables.table(spark, sf_dir, "conversations"), profile="conv_id", part="turn")
    return chats.where("text != ''").withColumn("text", F.expr(f"text || {tables.CHAT_TAIL}"))


@query
def preview(spark, sf_dir):
    return rank.preview(rank.top_matches(_scored(spark, sf_dir, one=True)))


# --- report ----------------------------------------------------------------


@query
def html_escape(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select(
        "page_id", text.escape_html(F.col("html")).alias("escaped")
    )


@query
def title_cell(spark, sf_dir):
    return tables.derive(spark, sf_dir, tables.POSTINGS).select(
        "posting_id", report.title_cell(F.col("job_title"), F.col("job_link")).alias("cell")
    )


@query
def report_rows(spark, sf_dir):
    top = rank.top_matches(_scored(spark, sf_dir, one=True))
    return report.report_rows(report.ranked(top))


@query
def report_html(spark, sf_dir):
    return report.report(rank.top_matches(_scored(spark, sf_dir, one=True)))


# --- sinks and whole runs --------------------------------------------------


@query
def scored_sink(spark, sf_dir):
    path = f"{_folder(spark)}/scored"
    sink.write_scored(_scored(spark, sf_dir, one=True), path)
    return _flat(spark.read.parquet(path))


@query
def safe_path(spark, sf_dir):
    """A second write to a taken path goes to a stamped sibling, whole."""
    path = f"{_folder(spark)}/postings.parquet"
    found = tables.derive(spark, sf_dir, tables.POSTINGS).select("posting_id", "job_title")
    first = sink.write_without_clobbering(found, path)
    second = sink.write_without_clobbering(found, path)
    return spark.read.parquet(second).withColumn("moved", F.lit(first != second))


@query
def batch_run(spark, sf_dir):
    """Top matches of a whole run, from files to files."""
    folder = _folder(spark)
    tables.derive(spark, sf_dir, tables.POSTINGS).write.parquet(f"{folder}/postings")
    parts = tables.profile_parts(spark).where("profile_id = 1")
    top = run_match(
        spark, f"{folder}/postings", parts, f"{folder}/scored", ordered=True,
        report_path=f"{folder}/report", staging_path=folder,
    )
    return _flat(top)


@query
def batch_run_many(spark, sf_dir):
    """A whole run with several profiles: the best rows of each."""
    folder = _folder(spark)
    tables.derive(spark, sf_dir, tables.POSTINGS).write.parquet(f"{folder}/postings")
    top = run_match(
        spark, f"{folder}/postings", tables.profile_parts(spark), f"{folder}/scored",
        report_path=f"{folder}/report", staging_path=folder,
    )
    return _flat(top, "rank")


@query
def batch_run_filtered(spark, sf_dir):
    """A whole run that selects by keyword, place and time."""
    folder = _folder(spark)
    timed = tables.derive(spark, sf_dir, tables.POSTINGS).withColumn(
        "posted_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(posting_id % 40))"))
    timed.write.parquet(f"{folder}/postings")
    options = MatchOptions(keyword="Automation", location="EN", as_of=datetime(2024, 1, 2, 16))
    top = run_match(
        spark, f"{folder}/postings", tables.profile_parts(spark), f"{folder}/scored", options,
        staging_path=folder,
    )
    return _flat(top, "rank")


@query
def run_reports(spark, sf_dir):
    """The page of each profile of a run."""
    top = rank.top_per_profile(_scored(spark, sf_dir))
    return report.reports(top)


@query
def display_sink(spark, sf_dir):
    """All raw columns and the scores under their headers, through CSV and back."""
    path = f"{_folder(spark)}/display"
    found = tables.postings(spark, sf_dir)
    sink.write_display(_scored(spark, sf_dir, one=True), found, path)
    back = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    # CSV does not tell an empty text from none.
    back = back.fillna("")
    return back.select(
        F.col("posting_id").cast("bigint"), F.col("profile_id").cast("bigint"), "location", "Job Title",
        F.md5("Job Description").alias("text_md5"), F.col("ATS Score").cast("double").alias("ATS Score"),
        "Matched Skills", "Missing Skills", "Recommendation")


@query
def pages_to_postings(spark, sf_dir):
    """Result pages to postings: blocked pages out, cards, ids, links, descriptions."""
    found = postings_from_pages(
        spread(tables.derive(spark, sf_dir, tables.CARD_PAGES), "page_id"),
        tables.derive(spark, sf_dir, tables.FETCHED_FOR_PAGES),
        blocked_marker="spam-farm", blocked_path=f"{_folder(spark)}/blocked",
    )
    return found.drop("posting_id")


@query
def incremental(spark, sf_dir):
    """Postings that land as several files, some of them twice."""
    return _flat(scored_so_far(spark, f"{_landed(spark, sf_dir)}/scored"))


@query
def incremental_top(spark, sf_dir):
    """The best of what each batch ranked."""
    tops = spark.read.parquet(f"{_landed(spark, sf_dir)}/top").drop("rank")
    return _flat(rank.top_matches(tops))


def _landed(spark, sf_dir) -> str:
    folder = _folder(spark)
    found = tables.derive(spark, sf_dir, tables.POSTINGS)
    # One file for a third of a small table; of a larger one as many as tasks can write.
    files = max(1, ceil((found.select(F.sum(F.octet_length("job_description"))).first()[0] or 0) / 3 / LANDED_BYTES))
    found.repartition(3 * files, "posting_id").write.parquet(f"{folder}/landed")
    found.where("posting_id % 3 = 0").repartition(files).write.mode("append").parquet(f"{folder}/landed")
    score_new_files(
        spark, f"{folder}/landed", tables.profile(spark), f"{folder}/scored",
        f"{folder}/checkpoint", schema=found.schema, max_files=2 * files,
        top_path=f"{folder}/top", report_path=f"{folder}/report",
    ).awaitTermination()
    return folder
