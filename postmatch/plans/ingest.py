"""From landed result pages to a posting table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch import fixed
from postmatch.options import MatchOptions
from postmatch.sources.descriptions import attach_descriptions
from postmatch.sources.search import card_rows, fail_if_blocked, page_cards, split_blocked


def postings_from_pages(pages: DataFrame, fetched: DataFrame,
                        options: MatchOptions | None = None, *,
                        key: str = "page_id",
                        blocked_marker: str = fixed.BLOCKED_MARKER,
                        blocked_path: str | None = None,
                        scope: str | None = fixed.RESULTS_ID) -> DataFrame:
    """Postings of all pages, with their descriptions.

    ``pages`` has ``key, url, html``; ``fetched`` has ``job_id, source, status,
    text`` and may have ``attempted_at``. A blocked page stops the run; with
    ``blocked_path`` the blocked pages are written there and the others go on.

    Every card becomes a posting unless ``options.card_cap`` says how many of a page
    do; ``total_cards`` tells how many there were. Where no fetched source has a
    text, the card's own text on the page is what is left. A posting's id is a hash of
    its page and position, both kept in the result.
    """
    options = options or MatchOptions()
    if blocked_path:
        usable, shut = split_blocked(pages, blocked_marker)
        shut.write.mode("overwrite").parquet(blocked_path)
    else:
        usable = fail_if_blocked(pages, blocked_marker)
    cards = card_rows(page_cards(usable, options.card_cap, carry=[key], scope=scope))
    numbered = cards.select(
        F.xxhash64(key, "position").alias("posting_id"),
        key, "position", "total_cards", "job_title", "job_link", "job_id",
        F.col("job_title").alias("ui_text"),
    )
    return attach_descriptions(numbered, fetched).drop("ui_text")
