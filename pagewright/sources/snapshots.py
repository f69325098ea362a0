"""Keyed tables as versioned snapshots.

A write never touches files that a reader may hold: new files of the key buckets it changes are written
beside the old ones, and a new manifest that names the valid folder of every bucket is put in place by one
rename that fails if that version exists. Readers open the newest manifest, so they see the table before or
after a write and nothing in between; a write that dies leaves files no manifest names. Two writers that
meet: the second merges its rows into the version of the first and tries again.

The number of buckets is a power of two that follows the size of the table, so a write moves the rows of
the buckets it touches only, whatever the size; when it doubles, the table is written anew once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import durable

ROWS_PER_BUCKET = 1_000_000
MANIFESTS, DATA = "_manifests", "data"


class Taken(Exception):
    """Another writer published this version first."""


class _Place:
    """The few file operations a snapshot needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = self.at(path)
        self.fs = root.getFileSystem(self.conf)
        self.root = str(self.fs.makeQualified(root))
        self.gateway = spark.sparkContext._gateway

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        place = self.at(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside, then rename; an existing file is never replaced."""
        draft = f"{self.root}/{MANIFESTS}/_draft-{uuid.uuid4().hex}"
        out = self.fs.create(self.at(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(self.root).toUri(), self.conf)
        try:
            context.rename(self.at(draft), self.at(f"{self.root}/{name}"), self.gateway.new_array(kinds, 0))
        except Py4JJavaError as failed:
            self.fs.delete(self.at(draft), False)
            if "FileAlreadyExists" in failed.java_exception.getClass().getName():
                raise Taken(name) from failed
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(f"{self.root}/{name}"), True)


def _versions(place: _Place) -> list[int]:
    return sorted(int(n[:-5]) for n in place.names(MANIFESTS) if n.endswith(".json") and not n.startswith(("_", ".")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest (or a given) version: buckets, schema, folder and rows of every bucket. None without any."""
    place = _Place(spark, path)
    known = _versions(place)
    if not known:
        return None
    return json.loads(place.text(f"{MANIFESTS}/{(known[-1] if version is None else version):020d}.json"))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as one version has it; later writes do not change what is read."""
    now = manifest(spark, path, version)
    if now is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return _rows(spark, path, now, now["folders"])


def _rows(spark: SparkSession, path: str, now: dict, buckets) -> DataFrame:
    schema = StructType.fromJson(now["schema"])
    folders = [f"{path.rstrip('/')}/{now['folders'][b]}" for b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def latest_per_key(existing: DataFrame, updates: DataFrame, keys: Sequence[str], at: str = "written_at") -> DataFrame:
    """One row per key, the last write wins; an update beats a stored row of the same time.

    An aggregate, not a window: rewrites of a busy key are combined before the shuffle.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.col(at), F.col("_new"))).alias("_row")) \
        .select("_row.*").select(*columns)


def buckets_for(rows: int, rows_per_bucket: int, least: int = 1) -> int:
    wanted = max(least, -(-rows // rows_per_bucket))
    return 1 << (wanted - 1).bit_length()


def upsert(updates: DataFrame, path: str, keys: Sequence[str], at: str = "written_at", rows_per_bucket: int = ROWS_PER_BUCKET,
           least: int = 1, stream: str | None = None, batch: int = -1, attempts: int = 20) -> int:
    """Merge ``updates`` into the table and return the version that holds them.

    A batch of a stream is written once: the manifest remembers the last batch of every stream.
    """
    spark = updates.sparkSession
    # What is merged must be what the buckets were worked out from, also when an executor is lost.
    staged = durable(updates)
    added = staged.count()
    for _ in range(attempts):
        now = manifest(spark, path)
        if now and stream is not None and now["batches"].get(stream, -1) >= batch:
            return now["version"]
        try:
            return _publish(spark, staged, added, path, list(keys), at, rows_per_bucket, least, stream, batch, now)
        except Taken:
            continue
    raise RuntimeError(f"{path}: {attempts} other writers were first")


def _publish(spark, staged: DataFrame, added: int, path: str, keys: list[str], at: str, rows_per_bucket: int, least: int,
             stream: str | None, batch: int, now: dict | None) -> int:
    place = _Place(spark, path)
    held = now or {"version": 0, "buckets": 0, "folders": {}, "rows": {}, "batches": {}, "schema": staged.schema.jsonValue()}
    buckets = max(held["buckets"], buckets_for(sum(held["rows"].values()) + added, rows_per_bucket, least))
    grown = buckets > held["buckets"]
    new = staged.withColumn("_bucket", _bucket(keys, buckets))
    # At most as many values as there are buckets.
    touched = sorted(held["folders"]) if grown else [str(r[0]) for r in new.select("_bucket").distinct().collect()]
    old = _rows(spark, path, held, [b for b in touched if b in held["folders"]]) if held["folders"] else staged.limit(0)
    merged = latest_per_key(old, staged, keys, at)
    folder = f"{DATA}/{held['version'] + 1:020d}-{uuid.uuid4().hex[:12]}"
    merged.withColumn("_bucket", _bucket(keys, buckets)).repartition(max(1, min(buckets, buckets if grown else len(touched))), "_bucket") \
        .write.partitionBy("_bucket").parquet(f"{path.rstrip('/')}/{folder}")
    counts = {}
    if place.fs.exists(place.at(f"{place.root}/{folder}")) and any(n.startswith("_bucket=") for n in place.names(folder)):
        counts = {str(r["_bucket"]): r["count"] for r in spark.read.parquet(f"{path.rstrip('/')}/{folder}").groupBy("_bucket").count().collect()}
    kept = (lambda side: {} if grown else held[side])
    after = {"version": held["version"] + 1, "buckets": buckets, "schema": merged.schema.jsonValue(),
             "folders": kept("folders") | {b: f"{folder}/_bucket={b}" for b in counts}, "rows": kept("rows") | counts,
             "batches": held["batches"] | ({stream: batch} if stream is not None else {})}
    try:
        place.publish(f"{MANIFESTS}/{after['version']:020d}.json", json.dumps(after))
    except (Taken, PySparkException):
        place.drop(folder)
        raise
    return after["version"]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove manifests but the last ``keep``, and folders none of those names; returns how many folders went.

    For a quiet hour: a reader of a removed version, or a write under way, would lose its files.
    """
    place = _Place(spark, path)
    known = _versions(place)
    for version in known[:-keep]:
        place.drop(f"{MANIFESTS}/{version:020d}.json")
    used = {f.rsplit("/", 1)[0] for v in known[-keep:] for f in manifest(spark, path, v)["folders"].values()}
    gone = [n for n in place.names(DATA) if f"{DATA}/{n}" not in used]
    for name in gone:
        place.drop(f"{DATA}/{name}")
    return len(gone)
