"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most two of 64 bits agree on two of four 16-bit quarters at least, so
every link is found inside one of six kinds of buckets of 32 equal bits. The distinct fingerprints of
a bucket are stored as vertical bit planes; all elements at one distance in the list are compared at
once, plane by plane, with carry-save counters (two planes of count and one of overflow), and words
in which every pair exceeds the radius are abandoned. A bucket larger than ``TILE`` is cut into tiles
and every pair of tiles becomes a group, so no task holds an unbounded bucket and no link is lost.
A bucket gives a spanning set of its links only; components come from star contraction.

Defined results: null and empty texts, and texts without words, have fingerprint zero, which links
like any other; rows with equal ids are separate rows; a component without any id has a null id; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import a_to_z_lower, arrow_stage, durable, lookup

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Distinct fingerprints of one bucket that are compared in one group.
TILE = 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.intp)


def fingerprint(text: str | None) -> int:
    """Majority bits of the shingle hashes, as an unsigned number."""
    words = a_to_z_lower(text or "").split()
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BITS) > len(hashes)).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(columns: list[pa.Array]) -> Iterator[list]:
    values = np.array([fingerprint(t.as_py()) for t in columns[1]], dtype=np.uint64)
    yield [columns[0], columns[2], pa.array(values.view(np.int64))]


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint as a signed long, and what tells rows of one id apart."""
    return arrow_stage(documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), _fingerprints,
                       "doc_id bigint, text_hash bigint, fp bigint", rows=2000)


def _buckets(fps: DataFrame) -> DataFrame:
    """bucket, tile, fps: groups of two or more distinct fingerprints that may link."""
    kinds = []
    for n, (a, b) in enumerate(combinations(range(4), 2)):
        part = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in (a, b)]
        kinds.append(F.lit(n << 32) + F.shiftleft(part[0], 16) + part[1])
    spread = fps.select("fp", F.explode(F.array(*kinds)).alias("bucket"))
    large = spread.groupBy("bucket").agg(F.count("*").alias("_m")).filter(F.col("_m") > TILE) \
        .select("bucket", F.ceil(F.col("_m") / TILE).cast("int").alias("_tiles"))
    tiled = lookup(spread, large, "bucket").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_tiles")).cast("int")
    tiled = tiled.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))) \
        .withColumn("tile", F.least("_own", "_other") * F.col("_tiles") + F.greatest("_own", "_other"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(parts, "bucket", "tile").groupBy("bucket", "tile").agg(F.collect_list("fp").alias("fps")) \
        .filter(F.size("fps") > 1)


def near(values: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (p, q) of pairs within the radius inside consecutive groups, distance by distance.

    ``sizes`` must not grow. All pairs at list distance s are compared in one sweep over the planes.
    """
    n = len(values)
    ends = np.repeat(np.cumsum(sizes), sizes)
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    words = -(-n // 64) + 1
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(64, words)
    for s in range(1, int(sizes[0])):
        active = int(sizes[sizes > s].sum())
        mask = np.zeros(-(-active // 64) * 64, np.uint8)
        mask[:active] = np.arange(s, active + s) < ends[:active]
        open_ = np.packbits(mask, bitorder="little").view("<u8").copy()
        at = np.flatnonzero(open_)
        open_ = open_[at]
        jump, turn = divmod(s, 64)
        low = planes
        ones, twos, over = (np.zeros(len(at), np.uint64) for _ in range(3))
        for b in range(64):
            plane = low[b]
            first = np.minimum(at + jump, words - 1)
            moved = plane[first]
            if turn:
                nxt = np.minimum(at + jump + 1, words - 1)
                moved = (moved >> np.uint64(turn)) | (plane[nxt] << np.uint64(64 - turn))
            differs = plane[at] ^ moved
            carry = ones & differs
            ones = ones ^ differs
            over |= twos & carry
            twos = twos ^ carry
            if b % 8 == 7:
                # Three or more differences: both counters set, or one carried beyond them.
                left = open_ & ~(over | (ones & twos))
                keep = left != 0
                if not keep.all():
                    at, open_, ones, twos, over = at[keep], left[keep], ones[keep], twos[keep], over[keep]
                    if not len(at):
                        break
                else:
                    open_ = left
        if len(at):
            found = np.unpackbits(open_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(found)
            p = at[word] * 64 + bit
            yield p, p + s


def _spanning(columns: list[pa.Array]) -> Iterator[list]:
    lists = columns[0]
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(-sizes, kind="stable")
    take = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in order]) if len(order) else []
    values = flat[np.asarray(take, dtype=np.intp)]
    if not len(values):
        return
    label = np.arange(len(values))
    out_a, out_b = [], []
    for p, q in near(np.ascontiguousarray(values).view(np.uint64), sizes[order]):
        parted = label[p] != label[q]
        if not parted.any():
            continue
        root = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                x = y
            return x

        for i, j in zip(p[parted].tolist(), q[parted].tolist()):
            a, b = top(int(label[i])), top(int(label[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out_a.append(values[i])
                out_b.append(values[j])
        old = np.array(sorted(root))
        new = np.array([top(x) for x in old.tolist()])
        spot = np.minimum(np.searchsorted(old, label), len(old) - 1)
        label = np.where(old[spot] == label, new[spot], label)
    yield [out_a, out_b]


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that span every set of fingerprints connected within one bucket."""
    return arrow_stage(_buckets(fps).select("fps"), _spanning, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components by alternating large and small stars.

    Neighbourhoods are never collected: each star is a minimum per node joined back to the edges.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = lookup(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b") \
            .unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        after = durable(small)
        # Stars are final when every node has one edge and no root is a node itself.
        roots = after.select(F.col("b").alias("a")).distinct()
        if after.count() == after.select("a").distinct().count() and after.join(roots, "a", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after


def grouped(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that names the component), component_id."""
    rows = durable(fingerprints(documents))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    stars = components(links(fps.select("fp")))
    linked = fps.join(stars.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    # Only fingerprints that more than one row shares or links to are joined back.
    side = linked.join(whole.filter("members > 1"), "root").select("fp", "root", "component_id")
    return lookup(rows, side, "fp").select(
        "doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    return grouped(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that remain if one row of every component stays.

    That is the row with the smallest id (ids before missing ids), of equal ids the one with the
    smaller text hash, and of rows equal in both any one.
    """
    return first_rows(documents, grouped(documents))


def first_rows(documents: DataFrame, members: DataFrame) -> DataFrame:
    """The same for any grouping: ``members`` has doc_id, text_hash and root of every row."""
    rows = durable(members)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")) \
        .select(F.col("f.doc_id").alias("_id"), F.col("f.text_hash").alias("_hash"))
    copies = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n"))
    kept = first.join(copies, first["_id"].eqNullSafe(copies["_id"]) & (first["_hash"] == copies["_hash"])) \
        .select(first["_id"], first["_hash"], "_n")
    out = documents.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k._id")) & (
        F.xxhash64("d.text") == F.col("k._hash")))
    # Only rows that repeat both id and text are compared with each other.
    return out.filter("k._n = 1").select("d.*").unionByName(
        out.filter("k._n > 1").select("d.*").dropDuplicates(["doc_id", "text"]))
