"""Removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
id. Suffix arrays hold suffixes at sync points only: of the 24-byte strings inside any ``LENGTH``
bytes the one with the smallest hash is a sync point, so equal strings have equal sync points and
every match contains one. An entry is a sync point's suffix, followed by the bytes before it from
the nearest one on, both as far as a match can reach: its sort order is the suffix order.

A batch of documents gets sorted runs, one for each bucket of sync points. Per bucket the runs enter
a logarithmic family: a run is merge-scanned against the level of its size, matches are reported,
and both merge into one of the next size. Of equal entries only the document with the smallest id
stays in the index, as it explains all that the others could. Entries that share a sync point but
differ before or behind it are compared by their windows of ``LENGTH`` bytes. In the end the
remaining levels merge, so any two entries meet exactly once.

Two passes over the texts keep the index small. The first finds sync points that two documents share;
they are told to the second by a filter of bounded size, whose false positives cost time, never rows.
Buckets grow in number with the data, not in size. Many copies within a batch are one entry.

Defined results: null texts are empty; texts shorter than ``LENGTH`` lose nothing; rows with equal ids
do not match each other; rows without id take no part and stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_stage, ship, unused

LENGTH = 50
SYNC = 24
REACH = LENGTH - SYNC
#: One entry: suffix, bytes before it backwards, lengths of both plus one.
WIDTH = LENGTH + REACH + 2
SPAN = LENGTH - SYNC + 1
#: Text bytes per bucket of the index, and per group of documents that are rewritten together.
BUCKET_BYTES = 8 << 20
GROUP_BYTES = 12 << 20
#: Text bytes per slice of the filter, and the most bits of all slices together (256 MB).
SLICE_BYTES = 64 << 20
MOST_BITS = 31
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ROLL = 0xD6E8FEB86659FD93


def _extreme(a: np.ndarray, n: int, f) -> np.ndarray:
    """Minimum or maximum of n consecutive values, by doubling."""
    have = 1
    while have * 2 <= n:
        a = f(a[:-have], a[have:])
        have *= 2
    return f(a[:len(a) - (n - have)], a[n - have:]) if have < n else a


def sync_points(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose 24-byte hash is the smallest of some LENGTH bytes around, and these hashes."""
    n = len(text) - SYNC + 1
    if len(text) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    h = eight[:n] * _MIX[0]
    h ^= h >> np.uint64(29)
    h += eight[8:8 + n] * _MIX[1]
    h ^= h >> np.uint64(31)
    h *= _MIX[2]
    h += eight[16:16 + n] * _MIX[0]
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    edge = np.zeros(SPAN - 1, np.uint64)
    least = np.concatenate((edge, _extreme(h, SPAN, np.minimum), edge))
    at = np.flatnonzero(_extreme(least, SPAN, np.maximum) == h)
    return at, h[at]


def _batch_points(texts: pa.Array, ids: pa.Array):
    """Bytes of all texts of a batch, and per sync point: place, text number, hash."""
    data = [(t or "").encode("utf-8", "replace") for t in (x.as_py() for x in texts)]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    at, number, hashes = [], [], []
    for i, text in enumerate(data):
        if known[i] and len(text) >= LENGTH:
            p, h = sync_points(text)
            at.append(p)
            hashes.append(h)
            number.append(np.full(len(p), i))
    if not at:
        return data, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return data, np.concatenate(at), np.concatenate(number), np.concatenate(hashes)


# ---- which sync points two documents share

def _slice_and_value(h: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice (a power of two of them) and 32 bits of a hash.

    Sync points are smallest hashes, so high bits are mostly zero; slices are cut by the low ones.
    """
    return (h & np.uint64(slices - 1)).astype(np.int64), (h >> np.uint64(24)).astype(np.uint32)


def _seen(columns: list[pa.Array], slices: int) -> Iterator[list]:
    """Per slice the sync points of a batch; one that several documents hold is named twice."""
    _, _, number, h = _batch_points(columns[1], columns[0])
    if not len(h):
        return
    ids = columns[0].to_numpy(zero_copy_only=False)[number].astype(np.int64)
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    other = np.concatenate(([False], ~first[1:] & (ids[1:] != ids[:-1])))
    # The first of each, and the first in a second document.
    start = np.flatnonzero(first)
    several = np.add.reduceat(other.astype(np.int64), start) > 0
    keep = np.sort(np.concatenate((start, start[several])))
    part, value = _slice_and_value(h[keep], slices)
    order = np.argsort(part, kind="stable")
    part, value = part[order], value[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    blobs = [value[a:b].astype("<u4").tobytes() for a, b in zip(cuts, [*cuts[1:], len(part)])]
    yield [part[cuts], pa.array(blobs, pa.binary())]


def _probes(value: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    v = value.astype(np.uint64)
    for mix in _MIX:
        yield ((v * mix) >> np.uint64(64 - bits)).astype(np.int64)


def _filter_slice(bits: int):
    def run(table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.frombuffer(b.as_py(), "<u4") for b in table.column("blob")]))
        shared = np.unique(values[1:][values[1:] == values[:-1]])
        flags = np.zeros(1 << bits, np.uint8)
        for place in _probes(shared, bits):
            flags[place] = 1
        return pa.table({"slice": [table.column("slice")[0].as_py()],
                         "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    return run


def shared_filter(documents: DataFrame, total: int) -> tuple[int, np.ndarray]:
    """Bits per slice, and the slices as rows of bytes."""
    count = 1 << max(8, (total // SLICE_BYTES).bit_length())
    bits = max(3, min(MOST_BITS, (total // 16).bit_length(), 31) - (count.bit_length() - 1))
    seen = arrow_stage(documents.select("doc_id", "text"), _seen, "slice bigint, blob binary", count, rows=4000)
    slices = seen.groupBy("slice").applyInArrow(_filter_slice(bits), "slice bigint, bits binary").toArrow()
    out = np.zeros((count, (1 << bits) // 8), np.uint8)
    for part, blob in zip(slices.column("slice").to_pylist(), slices.column("bits").to_pylist()):
        out[part] = np.frombuffer(blob, np.uint8)
    return bits, out


def _may_be_shared(h: np.ndarray, bits: int, slices: np.ndarray) -> np.ndarray:
    part, value = _slice_and_value(h, len(slices))
    out = np.ones(len(h), bool)
    for place in _probes(value, bits):
        out &= (slices[part, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


# ---- runs and levels

class Run:
    """Entries in suffix order, with the document, the row's tag and the place of each."""

    def __init__(self, keys, doc, tag, pos):
        self.keys, self.doc, self.tag, self.pos = keys, doc, tag, pos

    def take(self, at) -> "Run":
        return Run(self.keys[at], self.doc[at], self.tag[at], self.pos[at])

    def pack(self) -> bytes:
        return zstandard.compress(b"".join((np.int64(len(self.doc)).tobytes(), self.keys.tobytes(), self.doc.astype(
            "<i8").tobytes(), self.tag.astype("<u4").tobytes(), self.pos.astype("<u4").tobytes())), 1)

    @staticmethod
    def unpack(blob: bytes) -> "Run":
        raw = zstandard.decompress(blob)
        n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
        out = []
        for kind, size in ((f"S{WIDTH}", WIDTH), ("<i8", 8), ("<u4", 4), ("<u4", 4)):
            out.append(np.frombuffer(raw, kind, n, at))
            at += n * size
        return Run(out[0], out[1], out[2].astype(np.int64), out[3].astype(np.int64))

    @staticmethod
    def join(a: "Run", b: "Run") -> "Run":
        return Run(*(np.concatenate((getattr(a, f), getattr(b, f))) for f in ("keys", "doc", "tag", "pos")))


def _bytes_of(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), WIDTH)


def scan(run: Run, side: np.ndarray | None, report) -> Run:
    """Report what entries explain of each other; keep the smallest document of equal entries.

    ``run`` is sorted. With ``side`` only entries of different sides are compared anew.
    """
    n = len(run.doc)
    if n < 2:
        return run
    first = np.concatenate(([True], run.keys[1:] != run.keys[:-1]))
    start = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(run.doc, start), np.diff(np.append(start, n)))
    lost = np.flatnonzero(run.doc > least)
    if len(lost):
        raw = _bytes_of(run.keys[lost])
        before, behind = raw[:, -2].astype(np.int64) - 1, raw[:, -1].astype(np.int64) - 1
        whole = before + behind >= LENGTH
        lost_w = lost[whole]
        report(run.doc[lost_w], run.tag[lost_w], run.pos[lost_w] - before[whole], run.pos[lost_w] + behind[whole])
        stay = np.flatnonzero(run.doc == least)
        run, first = run.take(stay), None
        side = side[stay] if side is not None else None
        n = len(stay)
        first = np.concatenate(([True], run.keys[1:] != run.keys[:-1]))
    raw = _bytes_of(run.keys)
    sync = np.ascontiguousarray(raw[:, :SYNC]).view("<u8")
    head = np.concatenate(([True], (sync[1:] != sync[:-1]).any(1)))
    start = np.flatnonzero(head)
    sizes = np.diff(np.append(start, n))
    mixed = np.add.reduceat(first.astype(np.int64), start) > 1
    if side is not None:
        left = np.add.reduceat(side.astype(np.int64), start)
        mixed &= (left > 0) & (left < sizes)
    rows = np.flatnonzero(np.repeat(mixed, sizes))
    if len(rows):
        _windows(run.take(rows), raw[rows], report)
    return run


def _windows(run: Run, raw: np.ndarray, report) -> None:
    """Compare entries by each window of LENGTH bytes that contains their sync point."""
    text = np.concatenate((raw[:, LENGTH:LENGTH + REACH][:, ::-1], raw[:, :LENGTH]), axis=1)
    before, behind = raw[:, -2].astype(np.int64) - 1, raw[:, -1].astype(np.int64) - 1
    n = len(run.doc)
    low, high = np.full(n, -1), np.full(n, -1)
    roll, out = np.uint64(_ROLL), np.uint64(pow(_ROLL, LENGTH, 1 << 64))
    h = np.zeros(n, np.uint64)
    for c in range(LENGTH):
        h = h * roll + text[:, c]
    for j in range(REACH, -1, -1):
        at = REACH - j
        if at:
            h = h * roll + text[:, at + LENGTH - 1] - text[:, at - 1] * out
        rows = np.flatnonzero((before >= j) & (behind >= LENGTH - j))
        if len(rows) < 2:
            continue
        rows = rows[np.lexsort((run.doc[rows], h[rows]))]
        hs = h[rows]
        start = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
        lead = np.repeat(rows[start], np.diff(np.append(start, len(rows))))
        later = run.doc[rows] > run.doc[lead]
        rows, lead = rows[later], lead[later]
        if len(rows):
            same = (text[rows, at:at + LENGTH] == text[lead, at:at + LENGTH]).all(1)
            rows = rows[same]
            high[rows] = np.where(high[rows] < 0, j, high[rows])
            low[rows] = j
    hit = np.flatnonzero(high >= 0)
    if len(hit):
        report(run.doc[hit], run.tag[hit], run.pos[hit] - high[hit], run.pos[hit] + LENGTH - low[hit])


def merge(a: Run, b: Run, report) -> Run:
    both = Run.join(a, b)
    order = np.argsort(both.keys, kind="stable")
    return scan(both.take(order), (order < len(a.doc)), report)


class Family:
    """Levels of doubling size: level r holds 2 ** r batches."""

    def __init__(self, report):
        self.levels: dict[int, Run] = {}
        self.report = report

    def add(self, run: Run) -> None:
        rank = 0
        while rank in self.levels:
            run = merge(self.levels.pop(rank), run, self.report)
            rank += 1
        self.levels[rank] = run

    def close(self) -> Run | None:
        whole = None
        for rank in sorted(self.levels):
            whole = self.levels[rank] if whole is None else merge(whole, self.levels[rank], self.report)
        self.levels = {}
        return whole


class _Report:
    """Covered stretches, handed on by groups of documents."""

    def __init__(self, groups: int):
        self.groups, self.parts, self.n = groups, [], 0

    def __call__(self, doc, tag, start, end) -> None:
        self.parts.append(np.stack((doc, tag, start, end), axis=1))
        self.n += len(doc)

    def rows(self) -> tuple[list, list]:
        if not self.parts:
            return [], []
        all_ = np.unique(np.concatenate(self.parts), axis=0)
        self.parts, self.n = [], 0
        group = np.mod(all_[:, 0] ^ all_[:, 1], self.groups)
        order = np.argsort(group, kind="stable")
        all_, group = all_[order], group[order]
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        ends = [*cuts[1:], len(group)]
        return group[cuts].tolist(), [zstandard.compress(all_[a:b].astype("<i8").tobytes(), 1) for a, b in zip(cuts, ends)]


def _runs(columns: list[pa.Array], shared, bits: int, buckets: int, groups: int) -> Iterator[list]:
    """Sorted runs of a batch by bucket, and what its documents explain of each other.

    Rows: bucket, covered (true: the blob is a list of stretches for the group named in bucket), blob.
    """
    data, at, number, h = _batch_points(columns[2], columns[0])
    keep = _may_be_shared(h, bits, shared.value)
    at, number, h = at[keep], number[keep], h[keep]
    if not len(at):
        return
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(data) + bytes(LENGTH), np.uint8)
    bucket = ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at, number, bucket = at[order], number[order], bucket[order]
    ids, tags = columns[0].to_numpy(zero_copy_only=False), columns[1].to_numpy(zero_copy_only=False)
    report = _Report(groups)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        run = _entries(flat, starts, lengths, at[a:b], number[a:b], ids, tags)
        run = scan(run.take(np.argsort(run.keys, kind="stable")), None, report)
        yield [[int(bucket[a])], [False], pa.array([run.pack()], pa.binary())]
    group, blobs = report.rows()
    if group:
        yield [group, [True] * len(group), pa.array(blobs, pa.binary())]


def _entries(flat, starts, lengths, at, number, ids, tags) -> Run:
    before, behind = np.minimum(at, REACH), np.minimum(lengths[number] - at, LENGTH)
    here = (starts[number] + at)[:, None]
    raw = np.empty((len(at), WIDTH), np.uint8)
    ahead = np.arange(LENGTH)
    raw[:, :LENGTH] = np.where(ahead < behind[:, None], flat[here + ahead], 0)
    back = np.arange(1, REACH + 1)
    raw[:, LENGTH:-2] = np.where(back <= before[:, None], flat[np.maximum(here - back, 0)], 0)
    raw[:, -2], raw[:, -1] = before + 1, behind + 1
    return Run(raw.view(f"S{WIDTH}").ravel(), ids[number].astype(np.int64), tags[number].astype(np.int64), at.astype(np.int64))


def _families(groups: int):
    """All runs of a partition, each into the family of its bucket; stretches pass through."""
    schema = pa.schema([("group", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        report = _Report(groups)
        families: dict[int, Family] = {}
        for batch in batches:
            for bucket, covered, blob in zip(*(c for c in batch.columns)):
                if covered.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()]), pa.array([blob.as_py()], pa.binary())], schema=schema)
                else:
                    families.setdefault(bucket.as_py(), Family(report)).add(Run.unpack(blob.as_py()))
                if report.n > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(report.rows(), schema)], schema=schema)
        for bucket in list(families):
            families.pop(bucket).close()
        if report.n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(report.rows(), schema)], schema=schema)

    return run


# ---- the documents

def _tag() -> Column:
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


def _total(documents: DataFrame) -> int:
    return documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def covered(documents: DataFrame, total: int, groups: int) -> DataFrame:
    """group, blob: packed stretches (doc_id, tag, start, end) to remove."""
    spark = documents.sparkSession
    ship(spark)
    bits, slices = shared_filter(documents, total)
    shared = spark.sparkContext.broadcast(slices)
    buckets = max(64, -(-total // BUCKET_BYTES))
    runs = arrow_stage(documents.select("doc_id", _tag().alias("tag"), "text"), _runs,
                       "bucket bigint, covered boolean, blob binary", shared, bits, buckets, groups, rows=4000)
    return runs.repartition(buckets, "bucket", "covered").mapInArrow(_families(groups), "group bigint, blob binary")


def _stretches(tables: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Start and end of what goes, by row, in order of start."""
    parts = [np.frombuffer(zstandard.decompress(b.as_py()), "<i8").reshape(-1, 4) for b in tables.column("blob")]
    if not parts:
        return {}
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    cut = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
    return {(int(rows[a, 0]), int(rows[a, 1])): rows[a:b, 2:] for a, b in zip(cut, [*cut[1:], len(rows)])}


def kept(text: bytes, stretches: np.ndarray | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    if stretches is None:
        return text, []
    reach = np.maximum.accumulate(stretches[:, 1])
    first = np.concatenate(([True], stretches[1:, 0] > reach[:-1]))
    begins = stretches[first, 0].tolist()
    ends = reach[np.append(np.flatnonzero(first)[1:] - 1, len(reach) - 1)].tolist()
    parts, at = [], 0
    for a, b in zip(begins, ends):
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts), list(zip(begins, ends))


def _rewrite(left: pa.Table, right: pa.Table, tag: str, digest: bool):
    marks = _stretches(right)
    texts, out = [], [[], [], [], []]
    for doc, mark, text in zip(*(left.column(c).to_pylist() for c in ("doc_id", tag, "text"))):
        raw = (text or "").encode("utf-8", "replace")
        rest, spans = kept(raw, marks.get((doc, mark)) if doc is not None else None)
        if digest:
            for column, value in zip(out, (len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())):
                column.append(value)
        else:
            # A cut may split a character; what is left of it goes too.
            texts.append(text if not spans else rest.decode("utf-8", "ignore"))
    return texts, out


def _pack_rows(groups: int, tag: str):
    """Rows of a batch by group, compressed: texts move once, at less than half their size."""
    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            group = np.mod(ids ^ batch.column(tag).to_numpy(), groups)
            order = np.argsort(group, kind="stable")
            batch, group = batch.take(pa.array(order)), group[order]
            cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else []
            blobs = []
            for a, b in zip(cuts, [*cuts[1:], len(group)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(group[cuts] if len(cuts) else [], pa.int64()),
                                              pa.array(blobs, pa.binary())], names=["group", "rows"])

    return run


def _apply(documents: DataFrame, fields: StructType, digest: bool) -> DataFrame:
    total = _total(documents)
    groups = max(32, -(-total // GROUP_BYTES))
    stretches = covered(documents, total, groups)
    tag = unused(documents.columns, "_tag")
    rows = documents.withColumn(tag, _tag()).mapInArrow(_pack_rows(groups, tag), "group bigint, rows binary")
    names = [f.name for f in fields]
    lengths = "n_chars" in documents.columns

    def rewrite(packed: pa.Table, right: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(blob.as_py()).read_all() for blob in packed.column("rows")]
        left = pa.concat_tables(parts) if parts else None
        if left is None:
            return pa.table([pa.array([], f.type) for f in arrow], names=names)
        texts, sums = _rewrite(left, right, tag, digest)
        if digest:
            return pa.table([left.column("doc_id"), *(pa.array(c, pa.int64()) for c in sums[:3]), pa.array(sums[3], pa.string())],
                            names=names)
        new = left.set_column(left.column_names.index("text"), "text", pa.array(texts, pa.string()))
        if lengths and pa.types.is_integer(left.schema.field("n_chars").type):
            sizes = pa.array([None if t is None else len(t) for t in texts], left.schema.field("n_chars").type)
            new = new.set_column(new.column_names.index("n_chars"), "n_chars", sizes)
        return new.select(names)

    arrow = to_arrow_schema(fields)
    return rows.groupBy("group").cogroup(stretches.groupBy("group")).applyInArrow(rewrite, fields)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    fields = StructType([StructField("doc_id", LongType()), *(StructField(n, LongType()) for n in (
        "n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())])
    return _apply(documents.select("doc_id", "text"), fields, True)


def remove(documents: DataFrame) -> DataFrame:
    """The same rows and columns without repeated passages; n_chars follows the text."""
    return _apply(documents, documents.schema, False)
