"""Readers: supplied pages, folders of pages, labelled datasets, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.core import BLANK
from ..operators.specs import FIELD_TYPE

# A labelled dataset as JSON; each item nests its schema and its gold record.
DATASET_SCHEMA = (
    "name string, description string, items array<struct<item_id:string,url:string,html:string,"
    f"schema_spec:struct<name:string,description:string,domain:string,fields:array<{FIELD_TYPE}>>,"
    "gold_record:map<string,string>>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of the weighing column that one task of a spread table should take.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Use every core when a scan has fewer splits than cores; larger inputs stay where they are.

    A scan with so few splits is small by construction, so this shuffle is never a large one. With a
    ``weight`` (a text column that stands for a row's work) that is not taken for granted: a file of one
    row group is one task however long it is, so the column's bytes are summed by split, and rows are
    dealt to tasks of about ``TASK_BYTES`` once a split holds more than twice that.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if weight is not None:
        sums = df.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length(weight)).alias("n"))
        total, largest = sums.agg(F.sum("n"), F.max("n")).first()
        if (largest or 0) > 2 * TASK_BYTES:
            return df.repartition(max(cores, -(-total // TASK_BYTES)))
    return df.repartition(cores) if splits < cores else df


def supplied_pages(df: DataFrame, markup: str = "html") -> DataFrame:
    """Pages given with their markup count as fetched: outer blanks off, status 200."""
    return df.withColumn(markup, F.regexp_replace(markup, f"^{BLANK}+|{BLANK}+$", "")) \
        .filter(F.col(markup) != "").withColumn("status_code", F.lit(200))


def page_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of .html files keyed by file stem."""
    files = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"([^/]+)\.html$", 1).alias("item_id"), path.alias("url"),
                        F.col("value").alias("html"))


def labelled_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a dataset file, one row each."""
    data = spark.read.schema(DATASET_SCHEMA).option("multiLine", True).json(path)
    return data.select(F.col("name").alias("dataset_name"), F.inline("items"))


def explode_items(datasets: DataFrame) -> DataFrame:
    """The same from a column of JSON text (``payload``)."""
    return datasets.select(F.from_json("payload", DATASET_SCHEMA).alias("d")).select(
        F.col("d.name").alias("dataset_name"), F.inline("d.items"))


def require_schemas(items: DataFrame) -> DataFrame:
    """Stop the job on the first item without a schema."""
    return items.withColumn("schema_spec", F.when(F.col("schema_spec").isNull(), F.raise_error(
        F.concat(F.lit("item without schema: "), F.col("item_id")))).otherwise(F.col("schema_spec")))


def items_without_schema(items: DataFrame) -> DataFrame:
    return items.filter(F.col("schema_spec").isNull())


def page_views(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Add lines, text, title and headings. Columns nobody reads are pruned by the optimizer."""
    return pages.withColumn("lines", tx.lines_of(markup)) \
        .withColumn("text", tx.join_lines(F.col("lines"))) \
        .withColumn("title", tx.title_of(markup)) \
        .withColumn("headings", tx.headings_of(markup))


def dump_payload(value: Column) -> Column:
    return F.to_json(value)


def load_payload(text: Column, schema: str) -> Column:
    """Payload back to columns; anything but a JSON object gives nulls."""
    return F.from_json(F.when(F.ltrim(text).startswith("{"), text), schema)


def stored(df: DataFrame, key: str, value) -> DataFrame:
    """Lookup of a stored run, report or iteration; the filter reaches the file scan."""
    return df.filter(F.col(key) == F.lit(value))


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Older files lack newer columns: add them, and fill nulls, from {name: (type, default)}."""
    for name, (kind, default) in defaults.items():
        given = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(given.cast(kind), F.lit(default).cast(kind)))
    return df


def read_versions(spark: SparkSession, *paths: str, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    return with_defaults(spark.read.option("mergeSchema", True).parquet(*paths), defaults)
