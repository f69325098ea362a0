"""Percentiles of rolling event-time windows from stored hourly sketches.

An hour is summed up once, in a KLL sketch. Sketches merge, so the percentiles of any window of whole
hours come from the sketches of its hours, without its events. Where they must be exact, the sketch of
a window only says between which two values a wanted rank lies; one further pass counts what lies
below and keeps what lies between, and ``skew.settle`` finds the rank among the values kept.

Defined results: events without a time, and values that are null or NaN, take no part; a window without values
gives no row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .skew import KEY_ROWS, attach, settle

#: Size parameter of the sketches: some 50 kB an hour.
SKETCH = 2000


def rank_error(size: int = SKETCH) -> float:
    """Published error of a KLL sketch's rank, as a share of the rows, at 99 % confidence."""
    return 2.296 / size ** 0.9021


def _values(events: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return events.filter(F.col("ts").isNotNull() & v.isNotNull() & ~F.isnan(v)) \
        .select(F.window("ts", "1 hour")["start"].alias("hour"), v.alias("v"))


def hourly_sketches(events: DataFrame, value: str = "value", size: int = SKETCH) -> DataFrame:
    """hour, n, sketch: combined before the shuffle, so a busy hour is no larger than a quiet one."""
    return _values(events, value).groupBy("hour").agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("v", F.lit(size)).alias("sketch"))


def _starts(hour: Column, hours: int) -> Column:
    """Starts of the windows that hold an hour."""
    return F.sequence(hour - F.make_interval(hours=F.lit(hours - 1)), hour, F.expr("interval 1 hour"))


def window_sketches(hourly: DataFrame, hours: int = 24, size: int = SKETCH) -> DataFrame:
    """window_start, n, sketch of the windows of ``hours`` hours that begin at every hour."""
    return hourly.select(F.explode(_starts(F.col("hour"), hours)).alias("window_start"), "n", "sketch") \
        .groupBy("window_start").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def approximate(windows: DataFrame, points: Sequence[float]) -> DataFrame:
    """window_start, n, percentiles within ``rank_error`` of the wanted ranks: no event is read."""
    return windows.select("window_start", "n", F.array(
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in points]).alias("percentiles"))


def _counted(rows: DataFrame, brackets: DataFrame, hours: int) -> DataFrame:
    """_k, _q, _lo, _hi, _v, _c: how often values inside brackets occur; without _v, the rows below."""
    ends = brackets.withColumn("hour", F.explode(F.sequence(
        F.col("_k.window_start"), F.col("_k.window_start") + F.make_interval(hours=F.lit(hours - 1)), F.expr("interval 1 hour"))))
    listed = ends.groupBy("hour").agg(F.collect_list(F.struct("_k", "_q", "_lo", "_hi", "_from", "_to")).alias("_b"))
    met = attach(rows, listed, "hour", "inner")
    met = met.select("v", F.explode(F.filter("_b", lambda b: F.col("v") <= b["_to"])).alias("b"))
    return met.select("b._k", "b._q", "b._lo", "b._hi", F.when(F.col("v") >= F.col("b._from"), F.col("v")).alias("_v")) \
        .groupBy("_k", "_q", "_lo", "_hi", "_v").agg(F.count("*").alias("_c"))


def rolling_percentiles(events: DataFrame, points: Sequence[float] = (0.5, 0.95, 0.99), hours: int = 24,
                        value: str = "value", key_rows: int = KEY_ROWS, size: int = SKETCH,
                        windows: DataFrame | None = None) -> DataFrame:
    """Exact, linearly interpolated percentiles: window_start, n, percentiles (in order).

    ``windows`` takes stored window sketches, which else are made here. A bracket reaches three times
    the sketch's error to either side. Counts tell whether the rank lies in it; a window for which it
    does not is counted again over all its values, so the result never rests on the error's confidence.
    """
    if windows is None:
        windows = window_sketches(hourly_sketches(events, value, size), hours, size)
    windows = durable(windows)
    margin = 3 * rank_error(size)

    def bound(p: float, beyond: bool, end: float) -> Column:
        return F.lit(end) if beyond else F.kll_sketch_get_quantile_double("sketch", F.lit(p))

    brackets = F.array(*[F.struct(
        F.lit(q).alias("_q"), ((F.col("n") - 1) * F.lit(float(p))).alias("_at"),
        bound(p - margin, p <= margin, float("-inf")).alias("_from"),
        bound(p + margin, p + margin >= 1, float("inf")).alias("_to")) for q, p in enumerate(points)])
    wanted = windows.select(F.struct("window_start").alias("_k"), "n", F.inline(brackets)) \
        .withColumn("_lo", F.floor("_at").cast("bigint")).withColumn("_hi", F.ceil("_at").cast("bigint"))
    wanted = durable(wanted)
    rows = _values(events, value)
    live = durable(_counted(rows, wanted.drop("n", "_at"), hours))
    missed = _missed(live, wanted)
    if not missed.isEmpty():
        whole = missed.withColumn("_from", F.lit(float("-inf"))).withColumn("_to", F.lit(float("inf")))
        live = live.join(missed.select("_k", "_q"), ["_k", "_q"], "left_anti") \
            .unionByName(_counted(rows, whole, hours))
    below = live.filter("_v is null").select("_k", "_q", F.col("_c").alias("_skip"))
    kept = attach(live.filter("_v is not null"), below, ["_k", "_q"], "left").withColumn(
        "_skip", F.coalesce("_skip", F.lit(0)).cast("bigint"))
    return settle(kept, wanted, ["window_start"], key_rows)


def _missed(live: DataFrame, wanted: DataFrame) -> DataFrame:
    """The brackets that do not hold the wanted ranks."""
    sums = live.groupBy("_k", "_q").agg(F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("_below"),
                                        F.sum("_c").alias("_upto"))
    return durable(wanted.join(sums, ["_k", "_q"], "left").filter(
        F.col("_below").isNull() | (F.col("_below") > F.col("_lo")) | (F.col("_upto") <= F.col("_hi")))
        .select("_k", "_q", "_lo", "_hi"))
