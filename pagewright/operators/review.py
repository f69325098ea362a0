"""Human review rows and the publication of verified programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import unfold
from ..sources.sinks import upsert_programs
from .extract import effective
from .skew import attach


def review_fields(extracted: DataFrame, *keys: str) -> DataFrame:
    """One row per field for the reviewer; extracted and repaired values start as accepted."""
    keys = keys or ("page_id",)
    return unfold(extracted, keys, F.transform("results", lambda r: F.struct(
        r["field_name"].alias("field_name"), F.coalesce(effective(r), F.lit("")).alias("value"),
        r["status"].isin("extracted", "repaired").alias("accepted"),
        F.coalesce(r["error_message"], F.lit("")).alias("note"))))


def publish_gate(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """Decide each review (task_id, mark_verified, rules, ...): ``problem`` is null when it may stand.

    ``runs``: one row per task: task_id, checked (came from a rule check), passed, structure. A run with many reviews
    does not hold up one task.
    """
    seen = runs.select("task_id", F.col("checked").alias("_checked"), F.col("passed").alias("_passed"),
                       F.col("structure").alias("structure"))
    joined = attach(reviews, seen, "task_id")
    problem = F.when(F.col("mark_verified") & F.col("rules").isNull(),
                     "program_spec is required when mark_program_verified is true") \
        .when(F.col("mark_verified") & F.coalesce(F.col("_checked"), F.lit(False))
              & ~F.coalesce(F.col("_passed"), F.lit(False)),
              "quality check must pass before a rule can be verified")
    return joined.withColumn("problem", problem).drop("_checked", "_passed")


def promote(gated: DataFrame, programs: DataFrame) -> DataFrame:
    """Program table after publication: verified programs take the structure of their run."""
    new = gated.filter("problem is null and mark_verified").select(
        "schema_signature", "schema_name", F.lit(True).alias("user_verified"),
        F.coalesce(F.nullif(F.trim("rule_name"), F.lit("")), F.col("schema_name")).alias("rule_name"),
        "rules", "structure", F.col("reviewed_at").alias("created_at"))
    return upsert_programs(programs, new)
