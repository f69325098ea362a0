"""Folders of page files: one .html file a page, written by tasks and read whole."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the session's file system, the same for Spark and for tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return re.sub(r"^file:/+", "file:///", uri).rstrip("/")


def _file_name(item: str) -> str:
    # Readers take names that begin with a dot or an underscore for hidden files.
    name = urllib.parse.quote(item, safe="")
    return name.replace(name[0], f"%{ord(name[0]):02X}", 1) if name[0] in "._" else name


def write_page_files(pages: DataFrame, folder: str, item: str = "item_id", markup: str = "html") -> DataFrame:
    """One ``<item>.html`` a row; gives item, path and size of each file as it is written.

    Items are percent-encoded in file names, so any text makes one; items are unique. A file is written
    beside its name and renamed, so a lost task leaves no half page and its second run writes the same
    files again. Null markup is an empty file; rows whose item is null or empty are left out. Lazy: nothing is
    written before the result is used.
    """
    spark = pages.sparkSession
    ship(spark)
    place = _qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(place)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names, paths, sizes = batch.column(0).to_pylist(), [], []
            for name, text in zip(names, batch.column(1)):
                data = (text.as_py() or "").encode()
                path = f"{root}/{_file_name(name)}.html"
                with system.open_output_stream(f"{path}.{attempt}") as out:
                    out.write(data)
                system.move(f"{path}.{attempt}", path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())],
                                             names=["item_id", "path", "bytes"])

    rows = pages.filter(F.length(F.col(item).cast("string")) > 0).select(F.col(item).cast("string"), F.col(markup))
    return rows.mapInArrow(write, "item_id string, path string, bytes bigint")


def _decoded(name: Column) -> Column:
    # Only percent signs stand for something else in a path; a plus sign is one.
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_page_files(spark: SparkSession, folder: str, nested: bool = False) -> DataFrame:
    """Every .html file of a folder: ``item_id`` (path below the folder without ending), url, html, bytes, modified_at.

    The key depends on the file's place alone, so it is the same in every run, and files of one name in two
    nested folders stay apart. Spark packs many small files into one split, and a file is never divided. Its
    file sources pass over empty files, so an empty page is not read. Names are taken as ``write_page_files`` encodes them.
    """
    place = _qualified(spark, folder)
    files = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", nested).text(urllib.parse.unquote(place), wholetext=True)
    path = F.col("_metadata.file_path")
    # The path is an encoded URI of encoded names; both writings of a local root occur.
    below = F.regexp_replace(path, "^" + re.sub(r"^file:///", "file:/+", _quoted(place)) + r"/+|\.html$", "")
    return files.select(
        _decoded(_decoded(below)).alias("item_id"), path.alias("url"), F.col("value").alias("html"),
        F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified_at"))


def _quoted(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)
