"""Search against brute force: ties, copies, missing and odd vectors, wide components."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import topk

FIELDS = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=20, k=20):
    kept = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = tuple(math.floor(64 * x) for x in v)
            if all(abs(64 * x) < topk.EDGE for x in v):
                kept.setdefault((i, ints), None)
    out = []
    for q, a in kept:
        if q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def rows_of(spark, rows):
    exact = [(i, None if v is None else [float(x) if x is not None else None for x in v], n) for i, v, n in rows]
    table = spark.createDataFrame(exact, FIELDS).withColumn("pivot", F.lit("clash")).withColumn("v", F.lit(1))
    return table, [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]


@pytest.mark.parametrize("block", [1024, 16])
def test_clusters_copies_and_oddities(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(block)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], i) for i in range(400)]
    rows += [(i, [0.5] * 8, 0) for i in range(400, 500)]  # copies: all ties
    rows += [(500, None, 0), (501, [None] + [1.0] * 7, 0), (502, [float("nan")] * 8, 0), (503, [float("inf")] * 8, 0),
             (None, [9.0] * 8, 0), (504, [1e30] * 8, 0), (505, [0.0] * 8, 0), (520, [], 0), (521, [1.0, 2.0], 0)]
    rows += [rows[20], rows[40]]
    table, real = rows_of(spark, rows)
    assert sorted(map(tuple, topk.search(table).collect())) == plain(real)


def test_few_candidates_and_large_numbers(spark):
    rows = [(0, [2.0**24, -2.0**24], 0), (1, [2.0**24 - 1, 3.0], 0), (2, [-7.0, 2.0**23], 0), (20, [1.0, 1.0], 0)]
    table, real = rows_of(spark, rows)
    assert sorted(map(tuple, topk.search(table).collect())) == plain(real)


def test_components_beyond_31_bits(spark):
    big, small = [2.0**25, -2.0**25 - 8, 2.0**24, 3 * 2.0**23, 2.0**25 + 4], [1.0, -7.0, 0.0, 2.0**20, 3.5]
    rows = [(20 * n, [x, y, 0.5], 0) for n, (x, y) in enumerate((x, y) for x in big for y in small)]
    rows += [(n, [x, 1.0, y], 0) for n, (x, y) in enumerate(((x, y) for x in big for y in small), 1001)]
    rows += [(n, [float(n), -2.0, 1.0], 0) for n in range(601, 630)]
    table, real = rows_of(spark, rows)
    ints = {(i, tuple(math.floor(64 * x) for x in v)) for i, v, _ in real}
    want = []
    for q, a in ints:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.search(table).collect())) == sorted(want)


def test_score_beyond_64_bits(spark):
    with pytest.raises(Exception, match="OverflowError"):
        topk.search(spark.createDataFrame([(20, [2.0**40], 0), (21, [2.0**40], 0)], FIELDS)).collect()


def test_empty_table(spark):
    assert topk.search(spark.createDataFrame([], FIELDS)).collect() == []
    assert topk.search(spark.createDataFrame([(20, None, 1)], FIELDS)).collect() == []
