"""HTML report of the top matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.functions.text import comma_list, escape_html, strip
from postmatch.operators.rank import by_score, top_per_profile

COLUMNS = ("Job Title", "ATS Score", "Matched Skills", "Recommendation")
PAGE_TITLE = "Top matches"
TOP = 10


def title_cell(title: Column, link: Column) -> Column:
    """The escaped title, linked where the row has a web address.

    Other schemes, such as ``javascript:``, stay plain text.
    """
    shown = escape_html(F.coalesce(title, F.lit("")))
    address = strip(F.coalesce(link, F.lit("")))
    linked = F.concat(
        F.lit('<a href="'), escape_html(address), F.lit('">'), shown, F.lit("</a>")
    )
    return F.when(F.regexp_like(address, F.lit("(?i)^https?://")), linked).otherwise(shown)


def report_row(title: Column, link: Column, score: Column, skills: Column,
               advice: Column) -> Column:
    cells = (
        title_cell(title, link),
        F.concat(score.cast("string"), F.lit("%")),
        escape_html(skills),
        escape_html(advice),
    )
    inner = [part for cell in cells for part in (F.lit("<td>"), cell, F.lit("</td>"))]
    return F.concat(F.lit("<tr>"), *inner, F.lit("</tr>"))


def report_rows(top: DataFrame, *carry: str) -> DataFrame:
    """``rank, row_html`` for rows that carry their ``rank``."""
    return top.select(
        *carry,
        "rank",
        report_row(
            F.col("job_title"), F.col("job_link"), F.col("ats_score"),
            comma_list(F.col("matched_skills")), F.col("recommendation"),
        ).alias("row_html"),
    )


def report_page(rows: DataFrame, title: str = PAGE_TITLE, by: str | None = None) -> DataFrame:
    """One row ``html``: the report rows in rank order inside a page.

    ``by`` gives a page to each value of a column. ``rows`` holds the best k of each,
    so what one page gathers is bounded by k.
    """
    head = "".join(f"<th>{name}</th>" for name in COLUMNS)
    opening = (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head>'
        f"<body><h2>{title}</h2><table><thead><tr>{head}</tr></thead><tbody>"
    )
    fallback = f'<tr><td colspan="{len(COLUMNS)}">{fixed.NO_POSTINGS}</td></tr>'
    ordered = F.array_sort(F.collect_list(F.struct("rank", "row_html")))
    body = F.nullif(F.array_join(F.transform(ordered, lambda r: r["row_html"]), ""), F.lit(""))
    return (rows.groupBy(by) if by else rows).agg(
        F.concat(
            F.lit(opening), F.coalesce(body, F.lit(fallback)),
            F.lit("</tbody></table></body></html>"),
        ).alias("html")
    )


def ranked(top: DataFrame, k: int = TOP) -> DataFrame:
    """The best ``k`` rows, numbered by score; cut first, so one task numbers k rows."""
    order = Window.orderBy(F.desc("ats_score"), "posting_id", "profile_id")
    return by_score(top).limit(k).withColumn("rank", F.row_number().over(order))


def report(top: DataFrame, title: str = PAGE_TITLE, k: int = TOP) -> DataFrame:
    """The page of the best ``k`` rows."""
    return report_page(report_rows(ranked(top, k)), title)


def reports(top: DataFrame, k: int = TOP, title: str = PAGE_TITLE) -> DataFrame:
    """``profile_id, html``: a page of the best ``k`` rows for each profile."""
    best = top if "rank" in top.columns else top_per_profile(top, k)
    return report_page(report_rows(best.where(F.col("rank") <= k), "profile_id"), title, "profile_id")


def write_reports(top: DataFrame, path: str, k: int = TOP) -> None:
    """One folder per profile, ``profile_id=<id>``, with its page."""
    reports(top, k).write.mode("overwrite").partitionBy("profile_id").text(path)
