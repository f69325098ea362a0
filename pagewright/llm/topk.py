"""Exact top-k search by inner product over a pivot-distance index.

Vectors become integers floor(64 x). With one more coordinate sqrt(M^2 - |x|^2), M the largest norm,
the largest inner products are the smallest distances, so the triangle inequality applies: a vector
x of pivot p is no nearer to a query q than |d(q, p) - d(x, p)|.

Index: every vector is keyed by its nearest pivot and its distance to it and sorted by that key;
consecutive rows of one pivot form blocks (annuli) of at most ``BLOCK`` vectors with their inner and
outer radius. Sorting by range splits a crowded pivot over tasks. Queries form blocks of the same
kind. First each query block is scored against the annuli around its own place, which gives every
query a radius it need not look beyond; then the search expands to all annuli the bounds leave open,
in any cell, and stops there. Scores are exact integers; bounds carry a margin for rounding.

Defined results: vectors that are null, hold a null or a non-finite component, or a component whose
integer leaves 64 bits, take no part, nor do rows without id; a score that leaves 64 bits ends the
query with an error; shorter vectors count as zero beyond their end; equal rows are one row; a query has as many rows as there are candidates, at most k; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_stage, durable, parts_for, ship

SCALE = 64
#: Pivots; a bounded sample of vectors, each of which is indexed like any other.
PIVOTS = 64
BLOCK = 1024
EDGE = 1 << 63
#: Relative slack of the distance bounds.
MARGIN = 1e-9
BLOCKS = "pivot int, near double, far double, ids binary, data binary, wide boolean"


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: the integer vectors that take part."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (
        F.abs(x.cast("double") * SCALE) < float(EDGE)))
    return embeddings.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null") \
        .filter(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v")).distinct()


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length, zeros beyond the end of shorter ones."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Distances to all pivots, with the coordinate that evens out the norms."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T + (extra[:, None] - pivot_extra[None]) ** 2
    return np.sqrt(np.maximum(square, 0))


def _even(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x.astype(np.float64) ** 2).sum(1), 0))


def _place(columns, dim, most, pivots, as_query) -> Iterator[list]:
    x = _matrix(columns[1], dim)
    extra = np.zeros(len(x)) if as_query else _even(x, most)
    to = _distances(x, extra, pivots, _even(pivots, most))
    nearest = to.argmin(1)
    yield [columns[0], columns[1], nearest.astype(np.int32), to[np.arange(len(x)), nearest]]


def _cut(dim: int):
    """Blocks of sorted rows: one pivot each, at most BLOCK vectors."""
    def run(batches):
        def block(ids, rows, pivot, near):
            x = np.concatenate(rows)
            return {"pivot": int(pivot), "near": float(near[0]), "far": float(near[-1]),
                    "ids": np.concatenate(ids).astype("<i8").tobytes(), "data": x.astype("<i8" if wide(x) else "<i4").tobytes(),
                    "wide": wide(x)}

        def wide(x):
            return bool(len(x)) and float(np.abs(x).max()) ** 2 * dim >= 2 ** 52

        schema = pa.schema([("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()),
                            ("ids", pa.binary()), ("data", pa.binary()), ("wide", pa.bool_())])
        ids, rows, near, pivot, n = [], [], [], None, 0
        for batch in batches:
            keys, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            p, d = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            at = 0
            while at < len(keys):
                if n and (p[at] != pivot or n >= BLOCK):
                    yield pa.RecordBatch.from_pylist([block(ids, rows, pivot, np.concatenate(near))], schema=schema)
                    ids, rows, near, n = [], [], [], 0
                pivot = p[at]
                other = np.flatnonzero(p[at:at + BLOCK - n] != pivot)
                end = at + (int(other[0]) if len(other) else min(BLOCK - n, len(keys) - at))
                ids.append(keys[at:end])
                rows.append(x[at:end])
                near.append(d[at:end])
                n += end - at
                at = end
        if n:
            yield pa.RecordBatch.from_pylist([block(ids, rows, pivot, np.concatenate(near))], schema=schema)

    return run


def blocks(placed: DataFrame, dim: int) -> DataFrame:
    """pivot, near, far, ids, data: annuli in key order. Stored, as the cut must not change."""
    spark = placed.sparkSession
    ship(spark)
    n = placed.count()
    ranged = placed.repartitionByRange(parts_for(spark, n, 64 * BLOCK), "pivot", "distance", "vec_id")
    cut = ranged.sortWithinPartitions("pivot", "distance", "vec_id").mapInArrow(_cut(dim), BLOCKS)
    return durable(cut.withColumn("block", F.xxhash64("pivot", "near", "far", "ids")))


def _unpack(ids: bytes, data: bytes, wide: bool, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8" if wide else "<i4").reshape(-1, dim).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray, wide: bool) -> np.ndarray:
    """Exact inner products: in floating point while all sums stay below 2^53, else in integers."""
    if wide:
        return (q.astype(object) @ x.T.astype(object)).astype(np.int64)
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row: highest score, then smallest id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(columns, dim, k, most, pivots) -> Iterator[list]:
    """The best of one annulus for every query of a block that its bound leaves open."""
    names = ("q_ids", "q_data", "q_wide", "ids", "data", "wide", "pivot", "near", "far", "floors")
    for row in zip(*(c.to_pylist() for c in columns)):
        r = dict(zip(names, row))
        qid, q = _unpack(r["q_ids"], r["q_data"], r["q_wide"], dim)
        xid, x = _unpack(r["ids"], r["data"], r["wide"], dim)
        floors = np.frombuffer(r["floors"], "<f8") if r["floors"] else np.full(len(qid), -np.inf)
        norm = (q.astype(np.float64) ** 2).sum(1)
        p = pivots[r["pivot"]:r["pivot"] + 1]
        to = _distances(q, np.zeros(len(q)), p, _even(p, most))[:, 0]
        gap = np.maximum(np.maximum(r["near"] - to, to - r["far"]), 0) * (1 - MARGIN)
        bound = (norm + most - gap ** 2) / 2
        open_ = np.flatnonzero(bound + MARGIN * (norm + most + 1) >= floors)
        if not len(open_):
            continue
        scores = _products(q[open_], x, r["wide"] or r["q_wide"])
        out_q, out_x, out_s = [], [], []
        for i, row_scores in zip(open_, scores):
            other = xid != qid[i]
            high = other & (row_scores >= floors[i])
            at = np.flatnonzero(high)
            if len(at):
                at = at[_best(row_scores[at], xid[at], k)]
                out_q.append(np.full(len(at), qid[i]))
                out_x.append(xid[at])
                out_s.append(row_scores[at])
        if out_q:
            yield [np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)]


def _floors(columns, dim, k) -> Iterator[list]:
    """The k-th best score that each query of a block has found so far, per block."""
    for block, ids, found in zip(*(c.to_pylist() for c in columns)):
        known = {f["query_id"]: f["floor"] for f in found or []}
        own = np.frombuffer(ids, "<i8")
        yield [[block], [np.array([known.get(i, -math.inf) for i in own.tolist()], "<f8").tobytes()]]


def search(embeddings: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: exact best k for the rows whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = durable(vectors(embeddings))
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("most")).first()
    dim, most = max(shape["dim"] or 0, 1), float(shape["most"] or 0)
    # The pivots are the vectors with the smallest hashes: any choice is right, a spread one is fast.
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).toArrow()
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not chosen.num_rows:
        return spark.createDataFrame([], out)
    at = _matrix(chosen.column("v"), dim)
    fields = "vec_id bigint, v array<bigint>, pivot int, distance double"
    index = blocks(arrow_stage(rows, _place, fields, dim, most, at, False), dim)
    asked = blocks(arrow_stage(rows.filter(F.pmod("vec_id", F.lit(every)) == 0), _place, fields, dim, most, at, True), dim)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    tile = ["q_ids", "q_data", "q_wide", "ids", "data", "wide", "pivot", "near", "far", "floors"]
    hits = "query_id bigint, vec_id bigint, score bigint"

    def found(pairs: DataFrame) -> DataFrame:
        # Tiles are heavy and few: spread them evenly.
        spread = pairs.select(*tile).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return arrow_stage(spread, _search, hits, dim, k, most, at)

    # Where a query block lies in its own cell: the annuli it overlaps, or those just around it.
    home = asked.join(index, asked["q_pivot"] == index["pivot"]).withColumn(
        "_gap", F.greatest(F.col("near") - F.col("q_far"), F.col("q_near") - F.col("far"), F.lit(0.0)))
    nearest = home.groupBy("q_block").agg(F.min("_gap").alias("_least"))
    home = home.join(nearest, "q_block").filter("_gap <= _least").withColumn("floors", F.lit(None).cast("binary"))
    first = durable(found(home))
    top = first.groupBy("query_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("score"))), k, 1).alias("s")) \
        .filter(F.size("s") > 0).select("query_id", F.col("s")[0].cast("double").alias("floor"))
    members = arrow_stage(asked.select("q_block", "q_ids"), _members, "q_block bigint, query_id bigint")
    floors = members.join(top, "query_id").groupBy("q_block").agg(F.collect_list(F.struct("query_id", "floor")).alias("found"))
    floors = arrow_stage(asked.select("q_block", "q_ids").join(floors, "q_block", "left").select("q_block", "q_ids", "found"),
                         _floors, "q_block bigint, floors binary", dim, k)
    cells = arrow_stage(asked.join(floors, "q_block").select("q_block", "q_ids", "q_data", "q_wide", "floors"), _cells,
                        "q_block bigint, pivot int, low double, high double", dim, most, at)
    # Rings of every cell that some query of the block may still need.
    open_ = cells.join(index, "pivot").filter("near <= high and far >= low")
    rest = open_.join(asked.drop("q_pivot"), "q_block").join(floors, "q_block")
    every_hit = found(rest)
    # Ties and ranks: annuli of one query give at most k rows each.
    best = every_hit.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(
        F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.s")).cast("bigint").alias("score"))


def _members(columns) -> Iterator[list]:
    for block, ids in zip(*(c.to_pylist() for c in columns)):
        own = np.frombuffer(ids, "<i8")
        yield [np.full(len(own), block), own]


def _cells(columns, dim, most, pivots) -> Iterator[list]:
    """For each cell the ring within which a query of the block may find better vectors."""
    around = _even(pivots, most)
    for block, ids, data, wide, floors in zip(*(c.to_pylist() for c in columns)):
        _, q = _unpack(ids, data, wide, dim)
        floor = np.frombuffer(floors, "<f8")
        norm = (q.astype(np.float64) ** 2).sum(1)
        reach = np.sqrt(np.maximum(norm + most - 2 * floor, 0)) * (1 + MARGIN) + MARGIN * (1 + math.sqrt(most))
        to = _distances(q, np.zeros(len(q)), pivots, around)
        low, high = (to - reach[:, None]).min(0), (to + reach[:, None]).max(0)
        yield [[block] * len(pivots), list(range(len(pivots))), low, high]
