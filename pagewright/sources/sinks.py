"""Sinks: keyed upserts, program upserts, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import snapshots
from .snapshots import latest_per_key

__all__ = ["append", "drop_heavy", "latest_per_key", "read_upserted", "upsert_parquet", "upsert_programs"]

# Columns left out of stored results when business content is not retained.
HEAVY = ("input_html", "page_observation", "view_bundle", "benchmark_dataset")


def upsert_programs(existing: DataFrame, updates: DataFrame, key: str = "schema_signature") -> DataFrame:
    """Programs after an update; an update without a structure signature keeps the stored one."""
    columns = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*columns).alias("o"))
    last = updates.groupBy(key).agg(
        F.max_by(F.struct(*columns), "created_at").alias("n"),
        F.max_by("structure", F.when(F.col("structure").isNotNull(), F.col("created_at"))).alias("s"))
    joined = old.join(last, key, "full")

    def pick(name):
        if name == "structure":
            return F.coalesce("n.structure", "s", "o.structure")
        if name == "created_at":
            return F.coalesce("o.created_at", "n.created_at")
        return F.when(F.col("n").isNotNull(), F.col("n")[name]).otherwise(F.col("o")[name])

    return joined.select(key, *[pick(c).alias(c) for c in columns]).select(*existing.columns)


def drop_heavy(df: DataFrame, retain: bool = False) -> DataFrame:
    return df if retain else df.drop(*HEAVY)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_parquet(updates: DataFrame, path: str, keys: list[str], at: str = "written_at", buckets: int = 1) -> int:
    """Merge ``updates`` into a keyed table of snapshots with at least ``buckets`` buckets; returns the version."""
    return snapshots.upsert(updates, path, keys, at, least=buckets)


def read_upserted(spark, path: str) -> DataFrame:
    return snapshots.read(spark, path)
