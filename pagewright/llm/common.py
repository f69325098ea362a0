"""What the operators share: table access, row-wise Arrow stages, lookups that survive hot keys."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import durable, ship

__all__ = ["ship", "table", "arrow_stage", "lookup", "shared_folder", "durable", "parts_for", "crc32_mod", "a_to_z_lower",
           "A_TO_Z"]

#: Only A-Z change; every other code point keeps its case.
A_TO_Z = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}
#: Bytes of JSON text that a broadcast side with rows of any length may hold.
SMALL_BYTES = 64 << 20
_BYTES_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def a_to_z_lower(text: str) -> bytes:
    """UTF-8 bytes of a text with A-Z in lower case. In UTF-8 no other character has those bytes."""
    return text.encode("utf-8", "replace").translate(_BYTES_LOWER)


def arrow_stage(df: DataFrame, fn: Callable[..., Iterator[Sequence[list]]], schema: str, *args,
                rows: int = 10_000) -> DataFrame:
    """Run ``fn(columns, *args)`` on pieces of Arrow batches; it yields lists of output columns.

    ``fn`` must be a function of a module. A piece has at most ``rows`` rows, and Arrow's limit on
    the bytes of a batch: that bounds a worker's memory.
    """
    ship(df.sparkSession)
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                for columns in fn(batch.slice(start, rows).columns, *args):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
                         for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def lookup(big: DataFrame, side: DataFrame, key: str, how: str = "left", salts: int = 16,
           bound: int = 0, most_bytes: int | None = None) -> DataFrame:
    """Join rows with a side that has unique keys when a few keys may own a large share of the rows.

    Each key of the side is repeated once per salt, so a hot key is spread over ``salts`` tasks at
    the price of a larger side. Rows without a key match nothing and are spread too. Spark may still
    broadcast the side or split partitions at run time. A stored side of at most ``bound`` rows, and of
    at most ``most_bytes`` as JSON text where its rows may be of any length, is broadcast; both are
    measured, and the result is the same.
    """
    if bound and side.limit(bound + 1).count() <= bound and (
            most_bytes is None or (side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most_bytes):
        return big.join(F.broadcast(side), key, how)
    marked = big.withColumn("_salt", F.pmod(F.xxhash64(*_plain(big, key)), F.lit(salts)).cast("int"))
    # A missing key cannot match; a random-looking stand-in keeps such rows out of one task.
    kind = dict(big.dtypes)[key]
    stand_in = F.xxhash64(*_plain(big, key))
    if kind in ("bigint", "string"):
        marked = marked.withColumn("_key", F.coalesce(F.col(key), stand_in.cast(kind))) \
            .withColumn("_real", F.col(key).isNotNull())
    else:
        marked = marked.withColumn("_key", F.col(key)).withColumn("_real", F.col(key).isNotNull())
    copies = side.filter(F.col(key).isNotNull()).withColumnRenamed(key, "_key") \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_real", F.lit(True))
    return marked.join(copies, ["_key", "_salt", "_real"], how).drop("_key", "_salt", "_real")


def _plain(df: DataFrame, key: str) -> list[Column]:
    """Cheap columns that tell rows apart."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer")]
    return [F.col(n) for n in names] or [F.col(key)]


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder for intermediate tables, below the one all executors share.

    The place is ``spark.checkpoint.dir``; only a local session without it uses its own temporary
    folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        import tempfile
        base = os.path.join(tempfile.gettempdir(), "pagewright-shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about ``each`` units, at least as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each))


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of a value's text modulo n; a missing value counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it back: compact, and safe from lost executors."""
    place = shared_folder(df.sparkSession, what)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def unused(columns: list[str], name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
