import pytest

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table from (doc_id, text) pairs; extra columns clash with operators' own names."""
    def make(rows, extra=True):
        table = spark.createDataFrame(
            [(i, t, "en" if i is None or i % 2 else None, None if t is None else f"s{len(t) % 3}", None if t is None else len(t))
             for i, t in rows], FIELDS)
        if extra:
            from pyspark.sql import functions as F
            for name in ("fp", "root", "shard", "size", "words", "score", "predicted", "_tag", "h", "pos", "row", "bucket", "group"):
                table = table.withColumn(name, F.lit("clash"))
        return table

    return make


