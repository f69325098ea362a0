"""Near copies by word shingles: SimHash's bit-sliced comparison with a wide radius, then exact Jaccard.

Two documents are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8
or more. At that similarity fingerprints differ in some ten of 64 bits, so buckets of equal fingerprint
bits would miss pairs; buckets come from bands of MinHash values instead (a pair at 0.8 shares one of
``BANDS`` with a probability of 0.998). Texts with equal sets are one node. Every link is found in two
steps, and each is verified on the sets themselves:

* every node of a bucket against the bucket's first node; this joins large groups of copies at a cost in
  proportion to their size;
* in buckets that still hold several components, all pairs: fingerprints as vertical bit planes,
  carry-save counters, pairs beyond ``RADIUS`` abandoned, pairs inside one component left out. A bucket
  larger than ``TILE`` becomes pairs of tiles.

Sets hold 32 bits of every shingle's hash. Components come from star contraction.

Defined results: texts of fewer words have one shingle, the whole sequence; null and empty texts, and
texts without words, have none and are copies of each other; missing ids sort last; empty tables give no
rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import a_to_z_lower, arrow_stage, durable, lookup, stored
from .simhash import SEED, components, first_rows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Bits in which fingerprints of near copies may differ: ten on average at the least similarity, three deviations more than 9.
RADIUS = 22
#: Nodes of one bucket that are compared in one group.
TILE = 512
#: Node ids (eight bytes each) that are sent to all tasks; beyond that rows are shuffled.
NODES = 1_000_000
_PLANES = RADIUS.bit_length() + 1
_MULTIPLY = np.array([xxhash.xxh64_intdigest(b"multiply", i) | 1 for i in range(BANDS * ROWS)], np.uint64)
_ADD = np.array([xxhash.xxh64_intdigest(b"add", i) for i in range(BANDS * ROWS)], np.uint64)
_CHUNK = 4096


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    words = a_to_z_lower(text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(words))
    runs = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, len(words) - k + 1))


def _fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view(np.int64)[0])


def _bands(hashes: np.ndarray) -> list[int]:
    """One bucket key per band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), _CHUNK):
        mixed = (hashes[start:start + _CHUNK, None] >> np.uint64(32)) * _MULTIPLY + _ADD
        least = np.minimum(least, mixed.min(0))
    return [int(np.uint64(xxhash.xxh64_intdigest(part.tobytes(), i)).view(np.int64))
            for i, part in enumerate(least.reshape(BANDS, ROWS))] if len(hashes) else []


def _signatures(columns: list[pa.Array]) -> Iterator[list]:
    out: list[list] = [[], [], [], []]
    for text in columns[1]:
        hashes = shingles(text.as_py())
        held = np.unique(hashes.astype(np.uint32)).view(np.int32)
        node = int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).view(np.int64))
        for column, value in zip(out, (node, _fingerprint(hashes), _bands(hashes), held)):
            column.append(value)
    yield [columns[0], columns[2], *out]


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, fp, bands, held (the set) of every row."""
    return arrow_stage(documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), _signatures,
                       "doc_id bigint, text_hash bigint, node bigint, fp bigint, bands array<bigint>, held array<int>", rows=1000)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    return min(len(a), len(b)) >= SIMILARITY * max(len(a), len(b)) and jaccard(a, b) >= SIMILARITY


def _verified(columns: list[pa.Array]) -> Iterator[list]:
    left, right = (c.flatten().to_numpy(zero_copy_only=False) for c in columns[2:4])
    lo, ro = (c.offsets.to_numpy() for c in columns[2:4])
    keep = [_alike(left[lo[i] - lo[0]:lo[i + 1] - lo[0]], right[ro[i] - ro[0]:ro[i + 1] - ro[0]]) for i in range(len(columns[0]))]
    mask = pa.array(keep, pa.bool_())
    yield [columns[0].filter(mask), columns[1].filter(mask)]


def within(values: np.ndarray, n_first: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (p, q), p < q, of pairs within the radius; with ``n_first`` only pairs across that border.

    One value is compared with 64 others at once: planes of bits, counters of a few planes, and words in
    which every count has passed the radius are abandoned.
    """
    n = len(values)
    words = -(-n // 64)
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8").reshape(64, words)
    mine = padded[:, :n].astype(bool)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(n_first or n - 1):
        start = max(n_first, p + 1)
        at = np.arange(start // 64, words)
        mask = np.zeros(len(at) * 64, np.uint8)
        mask[start - 64 * at[0]:n - 64 * at[0]] = 1
        open_ = np.packbits(mask, bitorder="little").view("<u8").copy()
        counts = [np.zeros(len(at), np.uint64) for _ in range(_PLANES)]
        over = np.zeros(len(at), np.uint64)
        for b in range(64):
            carry = planes[b, at] ^ (every if mine[b, p] else np.uint64(0))
            for i, plane in enumerate(counts):
                counts[i], carry = plane ^ carry, plane & carry
            over |= carry
            if b % 16 == 15:
                # Count above the radius, from the highest plane down.
                above, same = over, np.full(len(at), every)
                for i in reversed(range(_PLANES)):
                    if radius >> i & 1:
                        same = same & counts[i]
                    else:
                        above, same = above | (same & counts[i]), same & ~counts[i]
                open_ = open_ & ~above
                keep = open_ != 0
                if not keep.all():
                    at, open_, over = at[keep], open_[keep], over[keep]
                    counts = [c[keep] for c in counts]
                    if not len(at):
                        break
        if len(at):
            word, bit = np.nonzero(np.unpackbits(open_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            q = at[word] * 64 + bit
            yield np.full(len(q), p), q


def _paired(columns: list[pa.Array]) -> Iterator[list]:
    """Verified links between components inside groups; a link found joins its components for the rest of the group."""
    out: tuple[list, list] = ([], [])
    for group in columns[0]:
        rows = group.values
        node, fp, label, side = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "fp", "label", "side"))
        order = np.lexsort((node, side))
        border = int((side == 0).sum()) if side.any() else 0
        held = rows.field("held")
        label = label[order].copy()
        for ps, qs in within(np.ascontiguousarray(fp[order]).view(np.uint64), border):
            for p, q in zip(ps.tolist(), qs.tolist()):
                if label[p] != label[q]:
                    a, b = (held[int(order[i])].values.to_numpy(zero_copy_only=False) for i in (p, q))
                    if _alike(a, b):
                        out[0].append(int(node[order[p]]))
                        out[1].append(int(node[order[q]]))
                        label[label == label[q]] = label[p]
    yield list(out)


def _tiles(members: DataFrame) -> DataFrame:
    """bucket, tile, node, label, side: groups of bounded size; members of tile pairs lie on two sides."""
    large = members.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles")).filter("_tiles > 1")
    tiled = lookup(members, large, "bucket").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    tiled = tiled.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int")) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return tiled.select("bucket", (F.least("_own", "_other") * F.col("_tiles") + F.greatest("_own", "_other")).alias("tile"),
                        "node", "label", (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, held of the wanted nodes; of rows with equal sets one."""
    return lookup(rows.select("node", "held"), wanted, "node", "inner", bound=NODES).groupBy("node").agg(F.first("held").alias("held"))


def links(rows: DataFrame) -> DataFrame:
    """a, b: verified links that connect what near copies connect, from the signatures of all rows.

    Sets move for nodes that share a bucket with others, no further.
    """
    nodes = durable(rows.select("node", "fp", "bands").dropDuplicates(["node"]))
    spread = nodes.select("node", F.posexplode("bands").alias("_b", "_key")) \
        .select("node", F.xxhash64("_b", "_key").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    members = stored(lookup(spread, shared, "bucket", "inner"), "similar")
    stars = members.filter("node <> lead").select("node", "lead").distinct()
    sets = durable(_sets(rows, stars.select("node").union(stars.select("lead")).distinct()))
    pairs = lookup(stars.join(sets, "node"), sets.select(F.col("node").alias("lead"), F.col("held").alias("_held")), "lead", "inner")
    found = durable(arrow_stage(pairs.select("node", "lead", "held", "_held"), _verified, "a bigint, b bigint", rows=2000))
    joined = components(found)
    labelled = members.join(joined, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label"))
    # Buckets whose members are not yet one component.
    several = labelled.groupBy("bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_z")).filter("_a <> _z").select("bucket")
    open_ = durable(lookup(labelled, several, "bucket", "inner"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = _tiles(open_).join(nodes.select("node", "fp").join(sets, "node"), "node").repartition(parts, "bucket", "tile") \
        .groupBy("bucket", "tile").agg(F.collect_list(F.struct("node", "fp", "label", "side", "held")).alias("rows")).filter(F.size("rows") > 1)
    rest = arrow_stage(groups.select("rows"), _paired, "a bigint, b bigint", rows=16)
    return found.unionByName(rest)


def grouped(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, root (a node that names the component) of every row."""
    rows = stored(signatures(documents), "similar")
    stars = components(links(rows))
    return lookup(rows.select("doc_id", "text_hash", "node"), stars, "node").select(
        "doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def keep_first(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that remain if one row of every component of near copies stays."""
    return first_rows(documents, grouped(documents))
