"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the fractional rank
(rank - 1/2) / rows of the source puts all sources on one scale. Sorted by it, the rows of every
source lie evenly, so equal cuts give shards that all hold the mixture. The law is ``rows``: counts
of shards differ by one at most.

Ranks never need a source, or everything, in one task: rows fall into buckets of the hash (then of
the fractional rank), bucket sizes are summed up, and a row's rank is the sum before its bucket plus
its place inside. The result does not depend on the number of buckets.

Defined results: a null text has size 16 and crc 0; a null source is a source of its own; rows with
equal ids are ordered by text hash and size, and rows equal in all of these are interchangeable; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, parts_for

#: Rows a bucket holds on average.
BUCKET_ROWS = 20_000


def _before(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows in the smaller buckets of the same keys, and of all of them."""
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("_in"))
    return sizes.withColumn("_before", F.sum("_in").over(
        Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")) \
        .withColumn("_all", F.sum("_in").over(Window.partitionBy(*keys))).drop("_in")


def _ranked(df: DataFrame, keys: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """``_rank`` from 0 over the whole of the keys, ``_all`` rows of them."""
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1
    return df.join(F.broadcast(_before(df, keys, bucket)) if not keys else _before(df, keys, bucket), [*keys, bucket]) \
        .withColumn("_rank", F.col("_before") + inside).drop("_before")


def assign(documents: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.col("source").cast("string").alias("_source"),
                            (F.octet_length(text) + 16).cast("bigint").alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = durable(rows)  # narrow; the texts are read once
    n = rows.count()
    buckets = max(64, -(-n // BUCKET_ROWS))
    spark = documents.sparkSession
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")) \
        .withColumn("_stratum", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit(""))) \
        .withColumn("_bucket", F.floor(F.shiftright("_h", 24).cast("double") / F.lit(float(1 << 40)) * buckets))
    own = _ranked(rows, ["_stratum"], "_bucket",
                  [F.col("_h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    spread = own.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_all")).drop("_rank", "_all", "_bucket") \
        .withColumn("_bucket", F.floor(F.col("_at") * buckets)) \
        .repartition(parts_for(spark, n, 250_000), "_bucket")
    sizes = spread.groupBy("_bucket").agg(F.count("*").alias("_in"))
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    # One row per bucket: a few thousand for a hundred million documents.
    sizes = sizes.withColumn("_before", F.sum("_in").over(whole) - F.col("_in")).drop("_in")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_at", "_stratum", "_h", "doc_id", "text_crc32", "size")) - 1
    placed = spread.join(sizes, "_bucket").withColumn("_pos", F.col("_before") + place)
    return placed.withColumn("shard", _exact_shard(F.col("_pos"), shards, n)).select(
        "doc_id", F.col("_source").alias("source"), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_pos") - _start(F.col("shard"), shards, n)).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def _exact_shard(pos: Column, shards: int, n: int) -> Column:
    """The first n % shards shards hold one row more."""
    each, more = divmod(n, shards)
    wide = more * (each + 1)
    return F.when(pos < wide, F.floor(pos / F.lit(each + 1))).otherwise(
        F.lit(more) + F.floor((pos - wide) / F.lit(max(each, 1)))).cast("int")


def _start(shard: Column, shards: int, n: int) -> Column:
    each, more = divmod(n, shards)
    return shard * F.lit(each) + F.least(shard, F.lit(more))
