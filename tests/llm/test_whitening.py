"""Whitening against plain exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pagewright.llm import whitening

FIELDS = "vec_id bigint, embedding array<float>, label int, x string, n string, deviation string, whitened string, k string, at string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, *["clash"] * 6) for i, v in rows], FIELDS)


def plain(rows, k=16):
    """n, sums, exact covariance and the integer vector of every row that takes part."""
    ints = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) and abs(c) <= 2.0**55 for c in v):
            ints.append((i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)))
    sizes = {}
    for x in {x for _, x in ints}:
        sizes[len(x)] = sizes.get(len(x), 0) + 1
    if not sizes:
        return None
    d = max(sizes, key=lambda s: (sizes[s], s))
    ints = [(i, x) for i, x in ints if len(x) == d]
    fit = sorted({x for _, x in ints})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    y = [[n * c - s for c, s in zip(x, sums)] for x in fit]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    deviation = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in ints]
    return ints, n, sums, cov, deviation


def rows_of(seed, n, d, scale=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate((rng.normal(size=(n, d)) @ mix * scale).tolist())]


ODD = [(900, None), (901, []), (902, [1.0, None, 3.0]), (903, [float("nan"), 1.0, 2.0]), (904, [float("inf"), 0.0, 0.0]),
       (905, [1.0, 2.0]), (None, [0.5, 0.25, -0.5]), (907, [1e30, 0.0, 0.0])]


@pytest.mark.parametrize("rows,d", [(rows_of(1, 60, 3) + ODD, 3), (rows_of(2, 200, 20), 20), (rows_of(3, 40, 3, 1e6), 3), (rows_of(4, 30, 3, 1e13), 3)])
def test_against_fractions(spark, rows, d):
    rows = rows + rows[:5] + [(7, rows[0][1])]  # repeated rows and ids
    ints, n, sums, cov, deviation = plain(rows)
    model = whitening.fit(table(spark, rows))
    assert (model.n, list(model.sums)) == (n, sums)
    values, axes = np.linalg.eigh(cov)
    k = min(16, d)
    assert np.allclose(model.values, values[::-1][:k], rtol=1e-12)
    assert np.allclose(np.abs((model.components * axes.T[::-1][:k]).sum(1)), 1, atol=1e-9)
    assert np.allclose(model.explained, values[::-1][:k] / values.sum(), rtol=1e-12)
    assert model.identity_error < 1e-6
    got = whitening.whiten(table(spark, rows), model).collect()
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got) == sorted((str(i), v) for i, v in deviation if v < 10**38)
    x = {i: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) for i, v in ints if i != 7}
    for r in got:
        if r["vec_id"] in x:
            assert np.allclose(r["whitened"], model.components @ x[r["vec_id"]] / np.sqrt(model.values), rtol=1e-9, atol=1e-9)


def test_square_sums_of_every_size():
    rng = np.random.default_rng(0)
    for peak in (9, 1 << 20, 1 << 33, 1 << 45, 1 << 58):
        y = rng.integers(-peak, peak, size=(500, 7))
        assert whitening._square_sums(y) == [sum(int(v) ** 2 for v in c) for c in y.T]


def test_digits_add_up():
    sums = [0, 5, -5, (1 << 70) + 3, -(1 << 100)]
    out = [0] * len(sums)
    for k, digit, value in zip(*whitening._digits(sums)):
        out[k] += value << (32 * digit)
    assert out == sums


def test_no_variance_and_no_rows(spark):
    one = whitening.whitened_components(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in one) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all((r["n"], r["deviation"], r["whitened"], r["identity_error"]) == (1, 0, None, None) for r in one)
    flat = whitening.whitened_components(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None) for r in flat) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    for rows in ([], [(1, None), (2, [])]):
        assert whitening.whitened_components(table(spark, rows)).count() == 0


def test_query_of_the_table(spark, folder):
    import __spark_entry__ as entry
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    _, n, _, cov, deviation = plain(rows)
    out = entry.queries()["op11_whitening"](spark, folder).collect()
    assert len(out) == 16 * len(deviation) and {r["n"] for r in out} == {n}
    assert {(r["vec_id"], r["deviation"]) for r in out} == set(deviation)
    values = np.linalg.eigvalsh(cov)[::-1]
    assert all(abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 for r in out)
    assert max(r["identity_error"] for r in out) < 1e-9
