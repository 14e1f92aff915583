"""Choose a posting's description among the sources that were fetched for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmatch import fixed

PAGE = "page"
JSON = "json"
UI = "ui"


def _usable(text: Column) -> Column:
    return F.nullif(F.coalesce(text, F.lit("")), F.lit(""))


def one_attempt(fetched: DataFrame) -> DataFrame:
    """One whole try of each source of a job id, from ``job_id, source, status, text``.

    With a column ``attempted_at`` that is the latest try. Without one it is the best:
    a text that came without failure, else a call without failure, else a refused one,
    else any; of equally good ones the lowest status and the first text.

    Spark cuts to one row before the exchange, and the rows stay dealt by id for the
    joins that follow.
    """
    status, text = F.col("status"), F.col("text")
    good = F.coalesce(status < 400, F.lit(True))
    order = [
        (good & _usable(text).isNotNull()).desc(), good.desc(),
        F.coalesce(status.isin(*fixed.BLOCKED_STATUSES), F.lit(False)).desc(),
        status.asc_nulls_last(), text.asc_nulls_last(),
    ]
    if "attempted_at" in fetched.columns:
        order.insert(0, F.col("attempted_at").desc_nulls_last())
    tries = Window.partitionBy("job_id", "source").orderBy(*order)
    return (
        fetched.where(F.col("source").isin(PAGE, JSON) & (F.col("job_id") != ""))
        .withColumn("_try", F.row_number().over(tries))
        .where("_try = 1")
    )


def choose(job_id: Column, page_status: Column, page_text: Column, json_status: Column,
           json_text: Column, ui_text: Column) -> dict[str, Column]:
    """The description and the name of its source.

    Without an id only the UI text counts. A refused page call skips the JSON
    source too. A failed call's text is not used.
    """
    refused = F.coalesce(page_status.isin(*fixed.BLOCKED_STATUSES), F.lit(False))
    no_id = F.coalesce(job_id, F.lit("")) == ""

    def if_ok(status: Column, text: Column) -> Column:
        failed = F.coalesce(status >= 400, F.lit(False))
        return F.when(~failed, _usable(text))

    page, json = if_ok(page_status, page_text), if_ok(json_status, json_text)
    ui = _usable(ui_text)
    use_ui = no_id | refused
    return {
        "job_description": F.coalesce(
            F.when(use_ui, ui).otherwise(F.coalesce(page, json, ui)), F.lit("")
        ),
        "description_source": F.when(
            ~use_ui & page.isNotNull(), PAGE
        ).when(~use_ui & json.isNotNull(), JSON).when(ui.isNotNull(), UI).otherwise("none"),
    }


def attach_descriptions(cards: DataFrame, fetched: DataFrame,
                        spread_by: str = "posting_id") -> DataFrame:
    """Add ``job_description`` and ``description_source`` to cards.

    ``cards`` has ``posting_id, job_id, ui_text``. Cards without an id get a join
    key of their own that matches nothing, so they do not pile up in one task. An id
    listed very often is split by Spark's skew join, which leaves the cards' side free
    to be split.
    """
    keyed = cards.withColumn(
        "_key",
        F.coalesce(
            _usable(F.col("job_id")),
            F.concat(F.lit("\x00"), F.col(spread_by).cast("string")),
        ),
    )
    tries = one_attempt(fetched)
    joined = keyed
    for source in (PAGE, JSON):
        own = tries.where(F.col("source") == source).select(
            F.col("job_id").alias("_key"),
            F.col("status").alias(f"{source}_status"), F.col("text").alias(f"{source}_text"))
        joined = joined.join(own, "_key", "left")
    chosen = choose(
        F.col("job_id"), F.col("page_status"), F.col("page_text"),
        F.col("json_status"), F.col("json_text"), F.col("ui_text"),
    )
    return joined.withColumns(chosen).select(
        *cards.columns, "job_description", "description_source"
    )
