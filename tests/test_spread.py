"""Rows dealt to tasks by the work they bring."""

from pyspark.sql import functions as F

from pagewright.plans import pages as plans
from pagewright.sources import tables


def test_no_task_takes_a_whole_long_file(spark, tmp_path):
    """One file of one row group is one task, however long it is."""
    spark.range(0, 1200, 1, 1).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.lit("x"), 100_000).alias("html")) \
        .write.parquet(str(tmp_path / "pages.parquet"))
    got = plans.pages(spark, str(tmp_path))
    sums = got.groupBy(F.spark_partition_id()).agg(F.sum(F.length("html")).alias("n"), F.count("*").alias("rows")).collect()
    assert max(r.n for r in sums) <= 1.2 * tables.TASK_BYTES and sum(r.rows for r in sums) == 1200
    assert got.select("page_id").distinct().count() == 1200


def test_small_and_empty_tables_use_every_core(spark):
    rows = spark.range(0, 40, 1, 1).select(F.when(F.col("id") > 0, "x").alias("html"))
    cores = spark.sparkContext.defaultParallelism
    for df in (rows, rows.filter("html is null"), rows.filter("html = ''")):
        got = tables.spread(df, "html")
        assert got.rdd.getNumPartitions() == cores and got.count() == df.count()
    assert tables.spread(spark.range(0, 40, 1, 20).select(F.lit("x").alias("html")), "html").rdd.getNumPartitions() == 20
