"""Outcome of page collection: classification, choice among attempts, failure reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .skew import attach

# Status codes that mark an access limit.
LIMITED = (401, 403, 429, 468)


def classify(status: Column, text: Column) -> Column:
    return F.when(status.isin(*LIMITED), "access_limited").when(status >= 400, "server_error") \
        .when(strip(F.coalesce(text, F.lit(""))) == "", "empty_page") \
        .when(status.isNull(), "unknown").otherwise("usable_content")


def classification_signal(status: Column, classification: Column) -> Column:
    return F.when(classification.isin("access_limited", "server_error"), F.format_string("http_%d", status)) \
        .when(classification == "empty_page", "empty_visible_text") \
        .when(classification == "unknown", "missing_http_response")


def classify_pages(pages: DataFrame) -> DataFrame:
    """Add classification and signal from ``status_code`` and ``text``."""
    return pages.withColumn("classification", classify(F.col("status_code"), F.col("text"))) \
        .withColumn("signal", classification_signal(F.col("status_code"), F.col("classification")))


def is_usable() -> Column:
    return F.col("classification") == "usable_content"


def usable(classified: DataFrame) -> DataFrame:
    return classified.filter(is_usable())


def rejected(classified: DataFrame) -> DataFrame:
    return classified.filter(~is_usable())


def resolve_attempts(attempts: DataFrame, key: str = "page_id") -> DataFrame:
    """The attempt that counts for each page: the first success unless an access limit came before.

    Plain aggregates, so a page tried many times is combined before the shuffle.
    """
    limited = F.col("classification") == "access_limited"
    success = F.col("classification") == "usable_content"
    grouped = attempts.groupBy(key).agg(
        F.min(F.when(limited, F.col("attempt_no"))).alias("limited_at"),
        F.min(F.when(success, F.col("attempt_no"))).alias("success_at"),
        F.min_by("collector", F.when(success, F.col("attempt_no"))).alias("success_collector"),
        F.max("attempt_no").alias("last_at"))
    won = F.col("success_at").isNotNull() & (F.col("limited_at").isNull()
                                            | (F.col("success_at") < F.col("limited_at")))
    return grouped.select(
        key, won.alias("collected"), F.when(won, F.col("success_at")).alias("attempt_no"),
        F.when(won, F.col("success_collector")).alias("collector"),
        F.when(won, F.col("success_at")).otherwise(F.least("limited_at", "last_at")).alias("attempts_made"))


def failure_reasons(attempts: DataFrame, key: str = "page_id") -> DataFrame:
    """One line per page that was never collected, naming each attempt up to the access limit.

    The text names every attempt that was made, so a page's line grows with its attempts; the rows of a page
    that was tried very often reach the join in several tasks.
    """
    note = F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.when(
        F.col("classification") == "empty_page", "empty visible text").otherwise(""))
    status = F.coalesce(F.col("http_status").cast("string"), F.lit("None"))
    text = F.concat(F.col("collector"), F.lit(": HTTP "), status, F.lit(", "), F.col("classification"),
                    F.lit(": "), note)
    outcome = resolve_attempts(attempts, key).select(key, "collected", "attempts_made")
    lost = attach(attempts, outcome, key, "inner").filter("not collected and attempt_no <= attempts_made")
    listed = lost.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("attempt_no", text.alias("t")))).alias("a"))
    return listed.select(key, F.concat(F.lit("page collection failed; attempts: "),
                                       F.array_join(F.col("a.t"), " | ")).alias("reason"))
