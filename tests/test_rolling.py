"""Rolling percentiles against numpy, and sketches against their stated error."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import rolling

SCHEMA = "ts timestamp_ntz, value double"
POINTS = (0.0, 0.5, 0.95, 0.99, 1.0)


def events():
    """An hour that holds a third of all rows, many equal values, a gap, values that take no part."""
    rng, start = random.Random(3), datetime(2024, 3, 1)
    rows = [(start + timedelta(minutes=rng.randrange(60 * 30)), rng.gauss(10, 4)) for _ in range(1500)]
    rows += [(start + timedelta(hours=7, minutes=rng.randrange(60)), float(rng.choice([1, 5, 5, 5, 90]))) for _ in range(900)]
    rows += [(start + timedelta(hours=80), 2.0), (None, 3.0), (start, None), (start, float("nan"))]
    return rows


def plain(rows, hours):
    held = defaultdict(list)
    for ts, v in rows:
        if ts is not None and v is not None and v == v:
            hour = ts.replace(minute=0, second=0, microsecond=0)
            for i in range(hours):
                held[hour - timedelta(hours=i)].append(v)
    return held


# Tiny sketches miss ranks, which are then counted again; few rows a key narrow brackets further.
@pytest.mark.parametrize("hours,size,key_rows", [(1, 2000, 1_000_000), (24, 2000, 50), (24, 8, 1_000_000), (5, 200, 20)])
def test_exact_percentiles(spark, monkeypatch, hours, size, key_rows):
    if size == 8:
        monkeypatch.setattr(rolling, "rank_error", lambda size: 0.0001)
    rows = events()
    got = rolling.rolling_percentiles(spark.createDataFrame(rows, SCHEMA), POINTS, hours, key_rows=key_rows, size=size).collect()
    want = plain(rows, hours)
    assert {r.window_start: r.n for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        assert r.percentiles == pytest.approx(np.quantile(want[r.window_start], POINTS).tolist(), rel=1e-9)


def test_sketches_keep_their_error_and_merge(spark):
    rows = events()
    hourly = rolling.hourly_sketches(spark.createDataFrame(rows, SCHEMA), size=200)
    for r in rolling.approximate(rolling.window_sketches(hourly, 24, 200), POINTS[1:4]).collect():
        values = np.sort(plain(rows, 24)[r.window_start])
        assert r.n == len(values)
        for p, v in zip(POINTS[1:4], r.percentiles):
            below, upto = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            off = 2 * rolling.rank_error(200) * len(values) + 1
            assert below - off <= p * len(values) <= upto + off


def test_empty_table(spark):
    assert rolling.rolling_percentiles(spark.createDataFrame([], SCHEMA)).collect() == []
