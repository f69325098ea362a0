"""Whitening of embeddings from polarised covariances.

Vectors become integers x. With S and n of the fit list (every distinct integer vector once), y = n*x - S
is an exact integer, centred before anything is multiplied. Spark sums y_i^2 of every dimension and
(y_i + y_j)^2 of every pair of dimensions exactly; the cross-covariance follows by polarisation,
2*cov_ij = var(i + j) - var(i) - var(j), as a quotient of whole numbers that is rounded once. Only these
d*(d+1)/2 sums come to the driver, whose eigh gives the components.

Squares are summed in 64 bits where a piece of rows cannot exceed them, in two halves of 24 bits beyond
that, and as Python integers for the largest values; no sum is ever rounded.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take no part,
nor do entries beyond 2**55, which no 64-bit centred integer can hold, nor vectors of another length
than most distinct vectors have (ties: the longer). Rows that repeat an id or a vector are each returned;
the fit list has a vector once. A component without variance has null whitened values. A deviation
beyond 38 digits is null, in the query one beyond 64 bits. An empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_stage, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 55)
#: Whole numbers travel as signed digits to this base, so that Spark can add them in 64 bits.
BASE_BITS = 32
HALF = 24


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: sums over the fit list, unit components (rows), eigenvalues and their shares."""
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    @property
    def middle(self) -> list[int]:
        return [s // self.n for s in self.sums]


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x: the integer vector of every row that takes part."""
    entry = F.col("embedding")
    whole = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LIMIT))
    return embeddings.filter((F.size(entry) > 0) & whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(
        entry, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint") + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _digits(sums: list[int]) -> list[list[int]]:
    """Columns k, digit, value of whole numbers; the sign goes to every digit."""
    out: list[list[int]] = [[], [], []]
    for k, total in enumerate(sums):
        sign, rest, digit = (-1 if total < 0 else 1), abs(total), 0
        while rest:
            for column, v in zip(out, (k, digit, sign * (rest & ((1 << BASE_BITS) - 1)))):
                column.append(v)
            rest >>= BASE_BITS
            digit += 1
    return out


def _added(digits: DataFrame, width: int) -> list[int]:
    """The exact sums: a few rows for each of the ``width`` numbers."""
    out = [0] * width
    for r in digits.groupBy("k", "digit").agg(F.sum("value").alias("value")).collect():
        out[r["k"]] += r["value"] << (BASE_BITS * r["digit"])
    return out


def _column_sums(columns: list[pa.Array]) -> Iterator[list]:
    x = _matrix(columns[0])
    high, low = x >> BASE_BITS, x & ((1 << BASE_BITS) - 1)
    yield _digits([(int(a) << BASE_BITS) + int(b) for a, b in zip(high.sum(0), low.sum(0))])


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n*x - S, in 64 bits where they suffice."""
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    z = x - np.array(middle, np.int64)
    if n * (int(np.abs(z).max(initial=0)) + 1) < 1 << 62:
        return z * n - np.array(rest, np.int64)
    return z.astype(object) * n - np.array(rest, object)


def _square_sums(y: np.ndarray) -> list[int]:
    """Exact column sums of squares."""
    if not y.size:
        return [0] * y.shape[1]
    peak = int(np.abs(y).max())
    if peak * peak * len(y) < 1 << 62:
        y = y.astype(np.int64, copy=False)
        return np.einsum("ij,ij->j", y, y).tolist()
    if (peak >> HALF) ** 2 * len(y) < 1 << 60 and len(y) < 1 << 14:
        y = y.astype(np.int64, copy=False)
        high, low = y >> HALF, y & ((1 << HALF) - 1)
        parts = zip(*(np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low))))
        return [(a << 2 * HALF) + (b << HALF + 1) + c for a, b, c in parts]
    y = y.astype(object)
    return [int(v) for v in (y * y).sum(0)]


def _polarised(columns: list[pa.Array], n: int, sums: tuple[int, ...]) -> Iterator[list]:
    """Sums of y_i^2, then of (y_i + y_j)^2 for j > i, dimension by dimension."""
    y = _centred(_matrix(columns[0]), n, sums)
    out = _square_sums(y)
    for i in range(y.shape[1] - 1):
        out += _square_sums(y[:, i + 1:] + y[:, i:i + 1])
    yield _digits(out)


def covariance(squares: list[int], d: int, n: int) -> np.ndarray:
    """Cross-covariances as differences of variances; whole numbers until the one division."""
    out, at = np.zeros((d, d)), d
    for i in range(d):
        out[i, i] = squares[i] / n**3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (squares[at] - squares[i] - squares[j]) / (2 * n**3)
            at += 1
    return out


def _project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Centred integers, and whitened values; not-a-number where a component has no variance."""
    y = _centred(x, model.n, model.sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.values > 0, 1 / np.sqrt(np.maximum(model.values, 0)), np.nan)
    return y, (y.astype(np.float64) / model.n) @ model.components.T * scale


def _moments(columns: list[pa.Array], model: Whitening) -> Iterator[list]:
    _, w = _project(_matrix(columns[0]), model)
    values = np.concatenate([w.sum(0), (w.T @ w).ravel()])
    yield [list(range(len(values))), values.tolist()]


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on every distinct integer vector; None without any."""
    distinct = stored(integers(embeddings).select("x").distinct(), "whitening")
    shape = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        return None
    d, n = shape["d"], shape["n"]
    vectors = distinct.filter(F.size("x") == d)
    parts = "k int, digit int, value bigint"
    sums = tuple(_added(arrow_stage(vectors, _column_sums, parts), d))
    squares = _added(arrow_stage(vectors, _polarised, parts, n, sums), d * (d + 1) // 2)
    matrix = covariance(squares, d, n)
    values, vectors_ = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], vectors_.T[::-1][:components]
    lead = axes[np.arange(len(axes)), np.abs(axes).argmax(1)]
    axes = axes * np.where(lead < 0, -1.0, 1.0)[:, None]
    trace = float(np.trace(matrix))
    real = values > max(float(values[0]), 0.0) * d * np.finfo(float).eps
    values = np.where(real, values, 0.0)
    model = Whitening(n, sums, axes, values, values / trace if trace > 0 else np.zeros(len(values)), None)
    if not real.any():
        return model
    k = len(values)
    found = {r["k"]: r["v"] for r in arrow_stage(vectors, _moments, "k int, v double", model)
             .groupBy("k").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([found[i] for i in range(k + k * k)]) / n
    error = np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k))[np.ix_(real, real)].max()
    return Whitening(n, sums, axes, values, model.explained, float(error))


def _whitened(columns: list[pa.Array], model: Whitening) -> Iterator[list]:
    y, w = _project(_matrix(columns[1]), model)
    peak = int(np.abs(y).max(initial=0))
    if peak * peak * y.shape[1] < 1 << 62:
        deviation = np.einsum("ij,ij->i", y.astype(np.int64, copy=False), y.astype(np.int64, copy=False)).tolist()
    else:
        deviation = [int(v) for v in (y.astype(object) ** 2).sum(1)]
    wide = [[None if v != v else v for v in row] for row in w.tolist()]
    yield [columns[0], [Decimal(v) if v < 10**38 else None for v in deviation], wide]


def whiten(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation decimal(38,0), whitened array<double> of every row of the model's dimensions."""
    rows = integers(embeddings).filter(F.size("x") == len(model.sums))
    return arrow_stage(rows, _whitened, "vec_id bigint, deviation decimal(38,0), whitened array<double>", model)


def whitened_components(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a vector and component."""
    model = fit(embeddings, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, "
                                                           "whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    each = whiten(embeddings, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
                       F.col("deviation").try_cast("bigint").alias("deviation"), "whitened",
                       F.get(explained, "at").alias("explained"),
                       F.lit(model.identity_error).cast("double").alias("identity_error"))
