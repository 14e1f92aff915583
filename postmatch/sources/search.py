"""Search addresses, the search's own filters, and the cards of a result page."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.functions.arrays import bind, quoted
from postmatch.operators.skew import top_per_group
from postmatch.sources import html

SEARCH_TEMPLATE = "https://jobs.example.com/search?keywords=%s&location=%s&f_TPR=r%d"


def quote(text: Column) -> Column:
    """Percent-encode for a path: slash and tilde stay, space becomes ``%20``."""
    text = F.url_encode(text)
    for encoded, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        text = F.replace(text, F.lit(encoded), F.lit(wanted))
    return text


def search_url(keyword: Column, location: Column, template: str = SEARCH_TEMPLATE,
               window_seconds: int = 86_400) -> Column:
    return F.format_string(template, quote(keyword), quote(location), F.lit(window_seconds))


def matches_search(title: Column, description: Column, location: Column, *,
                   keyword: str, place: str) -> Column:
    """Every word of the keyword in title or description; the place equal but for case.

    An empty keyword or place does not filter.
    """
    condition = F.lit(True)
    if place:
        condition = F.lower(location) == place.lower()
    words = keyword.lower().split()
    if words:
        each_word = " AND ".join(
            f"(contains(b.title, {quoted(w)}) OR contains(b.text, {quoted(w)}))" for w in words
        )
        lowered = {
            "title": F.lower(F.coalesce(title, F.lit(""))),
            "text": F.lower(F.coalesce(description, F.lit(""))),
        }
        condition = condition & bind("b", each_word, **lowered)
    return condition


def posted_recently(posted_at: Column, as_of: datetime, seconds: int = 86_400) -> Column:
    """Posted within the window before ``as_of``; a plain bound that scans can use.

    A time with a zone is moved to the session's zone; one without is read in it.
    """
    since = as_of - timedelta(seconds=seconds)
    if since.tzinfo is not None:
        zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
        since = since.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
    return posted_at >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")


def page_cards(pages: DataFrame, cap: int | None = None, *, url: str = "url",
               markup: str = "html", carry: Sequence[str] = (),
               scope: str | None = fixed.RESULTS_ID) -> DataFrame:
    """One row per card of each page, or its first ``cap`` cards, numbered from 1.

    ``total_cards`` counts before the cap; ``scope`` is that of :func:`html.cards`.
    ``base_url`` is what links are relative to. Everything happens inside the page's row.
    """
    listed = pages.withColumns({
        "_cards": html.cards(F.col(markup), scope), "base_url": html.base_url(F.col(markup), F.col(url))})
    shown = F.col("_cards") if cap is None else F.slice("_cards", 1, cap)
    return listed.select(
        *carry,
        url,
        "base_url",
        F.size("_cards").alias("total_cards"),
        F.posexplode_outer(shown).alias("_at", "card"),
    ).where(F.col("card").isNotNull()).select(
        *carry, url, "base_url", "total_cards", (F.col("_at") + 1).alias("position"), "card"
    )


def card_rows(cards: DataFrame, marker: str = fixed.LINK_MARKER,
              id_pattern: str = fixed.ID_IN_LINK, url: str = "url") -> DataFrame:
    """Add the card's title text, link and posting id."""
    base = "base_url" if "base_url" in cards.columns else url
    linked = cards.withColumn("_href", html.href(F.col("card"), marker)).withColumns(
        {
            "job_title": html.card_text(F.col("card")),
            "job_link": html.absolute(F.col("_href"), F.col(base)),
        }
    ).drop("_href")
    return linked.withColumn(
        "job_id", html.card_id(F.col("card"), F.col("job_link"), id_pattern)
    )


def first_rows(df: DataFrame, cap: int, order: str) -> DataFrame:
    """The first ``cap`` rows of one result list, numbered from 1.

    The list is cut by a distributed top-k before the single-task numbering, which
    so never sees more than ``cap`` rows.
    """
    kept = df.orderBy(order).limit(cap)
    return kept.withColumn("serial_number", F.row_number().over(Window.orderBy(order)))


def first_rows_per_search(df: DataFrame, cap: int, search: str, order: str) -> DataFrame:
    """The same cap for many result lists held in one table."""
    return top_per_group(df, [search], [F.asc(order)], cap, rank="serial_number")


def blocked(url: Column, marker: str = fixed.BLOCKED_MARKER) -> Column:
    return F.contains(url, F.lit(marker))


def split_blocked(pages: DataFrame, marker: str = fixed.BLOCKED_MARKER,
                  url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Pages to use, and pages whose landing address shows a block."""
    is_blocked = F.coalesce(blocked(F.col(url), marker), F.lit(False))
    return pages.where(~is_blocked), pages.where(is_blocked)


def fail_if_blocked(pages: DataFrame, marker: str = fixed.BLOCKED_MARKER, url: str = "url") -> DataFrame:
    """Stop the run at the first blocked page.

    The check is a filter: it runs whichever columns are read later.
    """
    stop = F.raise_error(F.lit("search was blocked")).cast("boolean")
    return pages.where(F.when(blocked(F.col(url), marker), stop).otherwise(F.lit(True)))
