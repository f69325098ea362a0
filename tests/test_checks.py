"""Checks of extracted values: what they cost a row, and that the short forms say what the long ones said."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions.core import collapse
from pagewright.functions.text import normalize_date, strip
from pagewright.operators import extract, specs, verify

ODD = ["", " ", "\n\t ", "[]", " [] ", "[ ]", "[]x", "a", " a b ", "abc", "  abc\n", "abcd", "　🙂🙂🙂 ", "🙂🙂🙂🙂", "a\n\nb", None]


def test_value_and_its_absence_are_worked_out_once(spark):
    empty = spark.range(0).selectExpr(f"CAST(array() AS array<{specs.FIELD_TYPE}>) AS fields",
                                      f"CAST(array() AS array<{extract.RESULT_TYPE}>) AS results")
    plan = empty.select(verify._issues_column())._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 8


def test_short_forms(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "x string")
    x = F.col("x")
    rows = df.select(
        x, verify.is_missing(x).alias("m"), (x.isNull() | strip(x).isin("", "[]")).alias("m2"),
        verify.matches_type(x, F.lit("text")).alias("t"), F.coalesce(x.isNotNull() & (collapse(x) != ""), F.lit(False)).alias("t2"),
        x.rlike(verify.THIN).alias("s"), (F.length(strip(x)) < 4).alias("s2")).collect()
    assert all(r.m == r.m2 and r.t == r.t2 and r.s == r.s2 for r in rows)


@pytest.mark.parametrize("texts, value, want", [
    (["x a  b y"], "a  b", True), (["x a  b y"], "a b", True), (["a b"], "a  b", True), (["2024-01-05"], "20240105", True),
    (["于2024年1月5日发布"], "2024-01-05", True), ([None], "a", False), ([None, "a"], "a", True), (["a"], " ", False), (["  "], " ", False),
    ([], "a", False), (["b"], "a", False)])
def test_support(spark, texts, value, want):
    df = spark.createDataFrame([([("t", t, 0, 1, 1.0) for t in texts], value)], f"e array<{extract.EVIDENCE_TYPE}>, v string")
    assert df.select(verify.supports(F.col("e"), F.col("v"))).first()[0] is want


@pytest.mark.parametrize("text, want", [
    ("2024-01-05", "2024-01-05"), ("2024-1-5", "2024-01-05"), ("2024-13-05", "2024-13-05"), ("2024-00-05", "2024-00-05"),
    ("2024.12.31日", "2024-12-31"), ("0024年2月3", "0024-02-03"), ("x20240230", "2024-02-30"), ("20241332", "20241332"), ("", "")])
def test_dates(spark, text, want):
    assert spark.range(1).select(normalize_date(F.lit(text))).first()[0] == want


def test_blank_runs_collapse_as_before(spark):
    from pagewright.functions import core
    rows = [(x,) for x in ODD if x is not None] + [(f"a{x}b{y}",) for x in (" ", "  ", "\t", " \t", "\t ", "　 ", " ") for y in (" ", "\n\n", "   ")]
    old = rf"[{core._WIDE}]{core.BLANK}*| {core.BLANK}+"
    df = spark.createDataFrame(rows, "x string")
    assert all(r.a == r.b for r in df.select(core.one_space(F.col("x")).alias("a"), F.regexp_replace("x", old, " ").alias("b")).collect())


def test_rules_are_dealt_to_fields_once_a_program(spark):
    fields, rules = specs._strings("b", "a"), F.array(*[specs._rule(n, "text_near_label", label=v) for n, v in (("a", "1"), ("b", "2"), ("a", "3"))])
    fields = F.transform(fields, lambda n: F.struct(n.alias("name"), n.alias("description"), F.lit("text").alias("type"), F.lit(False).alias("required"),
                                                    specs._strings().alias("aliases"), specs._strings().alias("examples")).cast(specs.FIELD_TYPE))
    pages = spark.createDataFrame([(1, "s", ["1: x"], "1: x"), (2, None, [], "")], "page_id int, schema_id string, lines array<string>, text string")
    got = extract.with_programs(pages, spark.range(1).select(F.lit("s").alias("schema_id"), fields.alias("fields"), rules.alias("rules")))
    dealt = {r.page_id: r.field_rules for r in got.select("page_id", "field_rules").collect()}
    assert [[r.labels for r in own] for own in dealt[1]] == [[["2"]], [["1"], ["3"]]] and dealt[2] is None
