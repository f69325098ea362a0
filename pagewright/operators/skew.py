"""Joins, positions and percentiles that hold when one key owns a large share of the rows."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

# A side is broadcast, or a key is handled inside one task, only up to these many rows.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
KEY_ROWS = 1_000_000
HOT_ROWS = 10_000_000
SALTS = 64


def fits_broadcast(side: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Measured: rows are counted up to the bound, bytes only once the count has passed."""
    if side.limit(rows + 1).count() > rows:
        return False
    size = side.select(F.length(F.to_json(F.struct(*side.columns))).alias("n")).agg(F.sum("n")).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def attach(big: DataFrame, side: DataFrame, on: str | Sequence[str], how: str = "left",
           rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, salts: int = SALTS,
           small: bool | None = None) -> DataFrame:
    """Join a lookup table with unique keys onto a large table whose keys may be skewed.

    A small lookup is broadcast and the large side does not move. Otherwise keys that own more
    than ``hot_rows`` rows are found first; only those are salted on the large side and repeated
    on the lookup side, so a hot key spreads over ``salts`` tasks and cold keys cost nothing.
    ``small`` passes on the answer of ``fits_broadcast`` when the caller already has it.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(side, rows) if small is None else small:
        return big.join(F.broadcast(side), keys, how)
    # At most (rows of big / hot_rows) keys qualify.
    hot = durable(big.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(
        *keys, F.lit(salts).alias("_n")))
    if hot.isEmpty():
        return big.join(side, keys, how)
    if fits_broadcast(hot, rows):
        hot = F.broadcast(hot)
    # A row without a key matches nothing; such rows are spread whatever their number.
    keyless = functools.reduce(operator.or_, [F.col(k).isNull() for k in keys])
    salt = F.when(keyless, F.pmod(F.xxhash64(*_hashable(big)), F.lit(salts))).otherwise(
        F.coalesce(F.pmod(F.xxhash64(*_hashable(big)), F.col("_n")), F.lit(0))).cast("int")
    salted = big.join(hot, keys, "left").withColumn("_salt", salt).drop("_n")
    copies = side.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(
        F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1))).drop("_n")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    """Cheap columns that differ between rows; the hash is a function of the data alone."""
    plain = [f.name for f in df.schema.fields
             if f.dataType.typeName() in ("long", "integer", "string", "timestamp", "double", "short")]
    return plain or [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return row[0] or 0


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
                  key_rows: int = KEY_ROWS) -> DataFrame:
    """1-based position of every row within its key. ``order`` must be total within a key.

    When no key exceeds ``key_rows`` this is a plain row_number. Otherwise rows are cut into
    ranges of (key, order), numbered inside each range, and shifted by the sizes of the ranges
    before it, so a hot key never sits in one task.
    """
    keys = list(keys)
    if largest_group(df, keys) <= key_rows:
        return df.withColumn(name, F.row_number().over(
            Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds are sampled, so the cut must be stored before two branches read it.
    cut = durable(df.repartitionByRange(max(parts, 2), *keys, *order)
                  .withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_range").count().select(
        *keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    local = cut.withColumn("_local", F.row_number().over(
        Window.partitionBy(*keys, "_range").orderBy(*order)))
    return _null_safe(local, sizes, [*keys, "_range"]).withColumn(
        name, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which missing keys are equal to each other."""
    other = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return left.join(other, same).drop(*[f"_r{i}" for i in range(len(keys))])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float],
                key_rows: int = KEY_ROWS, accuracy: int = 10_000, mean: str | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles: ``keys``, ``n`` and ``percentiles`` (in order).

    ``mean`` names a further column for the mean of the values.

    Keys with few rows use the built-in exact aggregate. For larger ones a mergeable sketch
    brackets each wanted rank, only the rows inside the bracket are kept (as value counts), and
    the bracket is narrowed again until it is small.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    largest = largest_group(rows, keys)
    if largest <= key_rows:
        grouped = rows.groupBy(*keys) if keys else rows
        extra = [F.avg("_v").alias(mean)] if mean else []
        return grouped.agg(F.count("_v").alias("n"),
                           F.percentile("_v", F.array(*[F.lit(p) for p in points])).alias("percentiles"), *extra)
    out = _narrowed(rows, keys, points, key_rows, accuracy)
    if mean:
        out = _null_safe(out, rows.groupBy(*keys).agg(F.avg("_v").alias(mean)), keys)
    return out


def _narrowed(rows: DataFrame, keys: list[str], points: Sequence[float], key_rows: int,
              accuracy: int) -> DataFrame:
    marked = rows.withColumn("_k", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    sizes = marked.groupBy("_k").agg(F.count("*").alias("n"))
    wanted = sizes.select("_k", "n", F.posexplode(F.array(*[F.lit(p) for p in points])).alias("_q", "_p")) \
        .select("_k", "n", "_q", ((F.col("n") - 1) * F.col("_p")).alias("_at")) \
        .withColumn("_lo", F.floor("_at").cast("bigint")).withColumn("_hi", F.ceil("_at").cast("bigint"))
    # Rows still in play per wanted rank, as value counts, with the number of rows below them.
    live = attach(marked, wanted.groupBy("_k").agg(F.collect_list(F.struct("_q", "_lo", "_hi")).alias("_w")),
                  "_k", "inner")
    live = live.select("_k", "_v", F.inline("_w"), F.lit(0).cast("bigint").alias("_skip"))
    live = live.groupBy("_k", "_q", "_lo", "_hi", "_skip", "_v").agg(F.count("*").alias("_c"))
    return settle(live, wanted, keys, key_rows, accuracy)


def settle(live: DataFrame, wanted: DataFrame, keys: Sequence[str], key_rows: int = KEY_ROWS, accuracy: int = 10_000) -> DataFrame:
    """``keys``, ``n`` and ``percentiles`` from value counts in play.

    ``live`` has _k (a struct of the keys), _q (number of the percentile), _lo and _hi (its ranks), _skip
    (rows below), _v and _c (a value and how often it occurs); ``wanted`` has _k, n, _q, _at, _lo.
    """
    before = None
    while True:
        live = durable(live)
        state = live.groupBy("_k", "_q").agg(F.count("*").alias("m"))
        most = state.agg(F.max("m")).first()[0] or 0
        if most <= key_rows or most == before:  # few enough, or nothing left to narrow
            break
        before = most
        live = _bracket(live, accuracy)
    upto = Window.partitionBy("_k", "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = live.withColumn("_end", F.col("_skip") + F.sum("_c").over(upto)) \
        .withColumn("_start", F.col("_end") - F.col("_c"))

    def at(rank):
        return F.max(F.when((F.col("_start") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy("_k", "_q").agg(at("_lo").alias("a"), at("_hi").alias("b")) \
        .join(wanted.select("_k", "_q", "n", "_at", "_lo"), ["_k", "_q"])
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("_at") - F.col("_lo"))
    out = picked.groupBy("_k").agg(F.max("n").alias("n"), F.transform(
        F.array_sort(F.collect_list(F.struct("_q", value.alias("x")))), lambda s: s["x"]).alias("percentiles"))
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], "n", "percentiles")


def _bracket(live: DataFrame, accuracy: int) -> DataFrame:
    """Keep the distinct values around the wanted ranks, counting the rows that fall below."""
    # Equi-depth cuts over distinct values; a heavy value is one row here.
    cuts = live.groupBy("_k", "_q").agg(F.percentile_approx(
        "_v", [i / 256 for i in range(1, 256)], accuracy).alias("_cuts"))
    binned = attach(live, cuts, ["_k", "_q"], "inner").withColumn(
        "_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    bins = binned.groupBy("_k", "_q", "_bin").agg(F.sum("_c").alias("_rows"), F.max("_lo").alias("_lo"),
                                                  F.max("_hi").alias("_hi"), F.max("_skip").alias("_skip"))
    before = Window.partitionBy("_k", "_q").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_from", F.col("_skip") + F.coalesce(F.sum("_rows").over(before), F.lit(0))) \
        .withColumn("_to", F.col("_from") + F.col("_rows"))
    keep = bins.filter((F.col("_to") > F.col("_lo")) & (F.col("_from") <= F.col("_hi")))
    first = keep.groupBy("_k", "_q").agg(F.min("_from").alias("_below"))
    chosen = keep.select("_k", "_q", "_bin").join(first, ["_k", "_q"])
    kept = attach(binned.drop("_skip"), chosen, ["_k", "_q", "_bin"], "inner")
    return kept.select("_k", "_q", "_lo", "_hi", F.col("_below").alias("_skip"), "_v", "_c")
