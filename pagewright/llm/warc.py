"""WARC archives of pages, and their index by an external merge.

Archives are written by Spark's text writer: a row is one record and the line separator is the blank
line that ends records, so files appear by Spark's commit protocol on any file system. Reading them
back gives one capture run per archive, sorted by (URL key, timestamp) and stored. The runs are cut
by range of that key and every range is merged by a loser tree over its runs, which yields capture
histories in global order.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the smallest page_id
is the response and the others revisit it; a revisit record holds the HTTP head but no payload.

Defined results: null html is an empty payload; a null url becomes a urn of the page; repeated rows
of the first page are all responses; rows without page_id revisit a page that has one, else all are
responses; any 64-bit page_id will do, its capture time lies between 2023 and 2055; an empty table gives no archives and no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, durable, lookup, parts_for, shared_folder, ship

MIN_REVISIT = 100
#: Bytes of payload an archive holds on average; rows of the index one merge range holds.
ARCHIVE_BYTES = 8 << 20
RANGE_ROWS = 50_000
#: Repeated payloads whose digests (some 100 bytes each) may be sent to all tasks instead of moving pages.
SMALL_SIDE = 200_000
#: Seconds over which captures are spread.
CAPTURE_SECONDS = 1_000_000_000
INDEX = ("urlkey string, captured string, archive string, offset bigint, record_bytes bigint, page_id bigint, "
         "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string")


def url_key(url: Column) -> Column:
    """Host labels from the top level down, then path and query: sorts captures of a site together."""
    rest = F.regexp_replace(F.lower(url), "^[a-z]+://(www[0-9]*\\.)?", "")
    host = F.regexp_extract(rest, "^[^/?#:]*", 0)
    tail = F.regexp_replace(F.substring(rest, F.length(host) + 1, F.length(rest)), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"),
                    F.when(tail == "", "/").otherwise(tail))


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, b) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                          for x in ([F.lit("-")] if i else []) + [F.substring(h, a, b)]])


def records(pages: DataFrame) -> DataFrame:
    """The payload of every page with digest, record type, and what it refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.regexp_replace("url", "[\\x00-\\x20]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(
            F.col("page_id").cast("string"), F.lit("none")))).alias("url"), html.alias("html")) \
        .withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)) \
        .withColumn("size", F.octet_length("html").cast("bigint"))
    # Only payloads that occur more than once take part in the join.
    first = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    joined = lookup(rows, durable(first), "digest", bound=SMALL_SIDE)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # Captures follow each other by a second per page id. Ids of 64 bits fold into some thirty years, so
    # that every date has a year of four digits and dates sort as text.
    when = F.date_format(F.timestamp_seconds(
        F.lit(1_700_000_000) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(CAPTURE_SECONDS))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return joined.withColumn("type", F.when(revisit, "revisit").otherwise("response")).withColumn("date", when)


def _as_text(rows: DataFrame) -> DataFrame:
    crlf = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))

    def head(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), crlf), F.lit(""))

    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"), head("WARC-Type", F.col("type")),
        head("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        head("WARC-Target-URI", F.col("url")), head("WARC-Date", F.col("date")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        head("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        head("WARC-Refers-To", F.when(revisit, F.concat(
            F.lit("<"), _record_id(F.col("first"), F.col("digest")), F.lit(">")))),
        head("X-Page-ID", F.col("page_id")), head("X-Refers-To-Page-ID", F.when(revisit, F.col("first"))),
        head("X-URL-Key", url_key(F.col("url"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), head("Content-Length", length), crlf, http,
        F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """Archives of about ``ARCHIVE_BYTES`` each below ``folder``."""
    total = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    each = max(1, ARCHIVE_BYTES * total["n"] // max(total["b"] or 0, ARCHIVE_BYTES))
    _as_text(records(pages)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", str(each)).text(folder)


class Record(NamedTuple):
    offset: int
    length: int
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def parse(data: bytes) -> Iterator[Record]:
    """Records of an uncompressed archive. Lengths decide where a record ends, never its content."""
    at = 0
    while at < len(data):
        if data[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        body = data.index(b"\r\n\r\n", at) + 4
        fields = _fields(data[at:body - 4])
        end = body + int(fields["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        start = data.index(b"\r\n\r\n", body, end) + 4
        yield Record(at, end + 4 - at, fields, _fields(data[body:start - 4]), data[start:end])
        at = end + 4


def _run_of(columns: list[pa.Array]) -> Iterator[list]:
    """One sorted capture run per archive; payloads are checked against their digests."""
    for path, content in zip(columns[0], columns[1]):
        name, rows = re.sub(r"^.*/", "", path.as_py()), []
        for r in parse(content.as_py()):
            kind, digest = r.fields["warc-type"], r.fields["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(r.payload).hexdigest() != digest:
                raise ValueError(f"{name}: payload at {r.offset} differs from its digest")
            page, refers = r.fields.get("x-page-id"), r.fields.get("x-refers-to-page-id")
            rows.append((r.fields["x-url-key"], r.fields["warc-date"], name, r.offset, r.length,
                         None if page is None else int(page),
                         len(r.payload) if kind == "response" else int(r.http["content-length"]), digest, kind,
                         None if refers is None else int(refers), r.fields["warc-record-id"].strip("<>")))
        rows.sort(key=lambda x: (x[0], x[1], x[3]))
        if rows:
            yield [list(c) for c in zip(*rows)]


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of all archives, one sorted run per archive."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    except AnalysisException:  # nothing was written
        return spark.createDataFrame([], INDEX)
    return arrow_stage(files.select("path", "content"), _run_of, INDEX)


class LoserTree:
    """Merges k sorted runs: inner nodes keep the loser of each match, so a step replays one path."""

    END = (1,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _key(self, run: int) -> tuple:
        i = self.at[run]
        return (0, self.runs[run][i], run) if i < len(self.runs[run]) else self.END

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0 and building:
                self.tree[node] = winner
                return
            if self._key(held) < self._key(winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self._key(winner := self.tree[0]) != self.END:
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self._replay(winner)


def _merge_range(batches):
    """All runs of one key range, in global order."""
    held, runs, n = [], {}, 0
    for batch in batches:
        held.append(batch)
        for row in zip(*(batch.column(c).to_pylist() for c in ("urlkey", "captured", "archive", "offset"))):
            runs.setdefault(row[2], []).append((*row, n))
            n += 1
    if n:
        order = [row[4] for row in LoserTree(list(runs.values()))]
        yield from pa.Table.from_batches(held).take(pa.array(order)).to_batches(max_chunksize=4096)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The index of all archives in global order of URL key and timestamp."""
    n = runs.count()
    order = ["urlkey", "captured", "archive", "offset"]
    ranged = runs.repartitionByRange(parts_for(runs.sparkSession, n, RANGE_ROWS), *order)
    ship(runs.sparkSession)
    return ranged.sortWithinPartitions("archive", "urlkey", "captured", "offset").mapInArrow(_merge_range, INDEX)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read them back, and give the merged index."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write(pages, f"{folder}/archives")
    # The runs are stored: the range cut below reads them twice, the archives only once.
    capture_runs(spark, f"{folder}/archives").write.parquet(f"{folder}/runs")
    return merge_runs(spark.read.schema(INDEX).parquet(f"{folder}/runs"))
