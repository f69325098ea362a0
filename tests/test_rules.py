"""Label trees and literal patterns against plain loops, and against the column forms."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions.core import let, unfold
from pagewright.operators import extract, labels, patterns, specs
from pagewright.plans import all_queries

SEPARATORS = "：:-"


def plain_hits(lines, names):
    """line, label, value: every label a line begins with, if a value stands behind its separator; longest first."""
    out = []
    for line in lines:
        for name in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
            rest = line[len(name):].lstrip(" ") if line.startswith(name) else ""
            value = " ".join(rest[1:].split()) if rest[:1] and rest[0] in SEPARATORS else ""
            if value:
                out.append((line, name, value))
    return out


def hits(spark, lines, names, known):
    df = spark.createDataFrame([(lines, names)], "lines array<string>, names array<string>") \
        .withColumn("walk", labels.label_walk(F.col("names")))
    texts = [r[0] for r in df.select("walk.pattern").collect() if r[0]] if known else ()
    return [tuple(h) for h in df.select(labels.label_hits(F.col("lines"), F.col("walk"), texts).alias("h")).first().h]


CASES = [
    (["Date: 1", "Date - Time: 2", "Date Time: 3", "Dated: 4", " Date: 5"], ["Date", "Date - Time", "Date Time", "D"]),
    (["a.b: 1", "axb: 2", "a\\Eb: 3", "[x]: 4", "🙂é: 5", "🙂: 6"], ["a.b", "a\\Eb", "[x]", "🙂é", "🙂"]),
    (["日期：", "日期： 二", "日期时间-三", "日：四", ": 5"], ["日期", "日期时间", "日", ""]),
    ([], ["a"]), (["a: b"], []), (["a: b"], [None, "", "a"]),
    ([f"label {i}: {i}" for i in range(0, 400, 7)], [f"label {i}" for i in range(400)]),
]


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("lines,names", CASES)
def test_hits_of_a_label_tree(spark, lines, names, known):
    assert hits(spark, lines, names, known) == plain_hits(lines, names)


def test_hits_of_random_labels(spark):
    rng = random.Random(2)
    letters = "ab日 .:-"
    for _ in range(12):
        names = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))).strip() for _ in range(12)]
        lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
        assert hits(spark, lines, names, True) == plain_hits(lines, names)


def test_one_engine_call_a_line_whatever_the_labels(spark):
    """The tree is one pattern: its size follows the labels, the calls on a line do not."""
    few, many = ([f"field {i}" for i in range(n)] for n in (2, 500))
    walk = [spark.createDataFrame([(n,)], "names array<string>").select(labels.label_walk(F.col("names")).alias("w")).first().w for n in (few, many)]
    assert walk[0].chains == {} and len(walk[1].pattern) < 12 * 500
    assert len(walk[1].chains["field 123"]) == 3  # field 123, field 12, field 1


PATTERNS = [r"x(\d+)", r"x\d+", r"(?<=a)b", r"^b(.*)$", r"", r"c*", r"(a)|(b)", r"(a)\1", r"\Qa.b\E", r"(?x) a b # c", r"É+", r"(?=(b))", r"$", r"(?s)a.+c"]
TEXTS = ["xx42 x7", "ab", "aab\nbcc\nb", "", "ccc", "a.b", "éÉ", "🙂🙂 x42", "no", "a\x01x42", "x" * 300 + "1", "$1 x9 \\"]


def found(spark, known):
    ready = spark.createDataFrame([(t, p) for t in TEXTS for p in PATTERNS], "text string, given string") \
        .withColumn("pattern", F.concat(F.lit(patterns.FLAGS), specs.java_pattern(F.col("given")))) \
        .withColumn("grouped", extract.has_group(F.col("given")))
    every = sorted({(r.pattern, r.grouped) for r in ready.select("pattern", "grouped").collect()})
    hit = extract.by_pattern(F.col("text"), F.col("pattern"), F.col("grouped"), every if known else ())
    return sorted(map(tuple, ready.select("text", "pattern", hit.alias("h")).select(
        "text", "pattern", F.col("h.value").alias("v"), "h.evidence.text", "h.evidence.start_char", "h.evidence.end_char").collect()), key=str)


def test_literal_patterns_equal_the_column_form(spark):
    assert found(spark, True) == found(spark, False)


def test_plans_hold_literal_patterns(spark, folder):
    for name in ("extract_publisher_regex", "pages_without_program"):
        plan = all_queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert r"\A((?s:.*?))(?imUd:" in plan or "^(?:" in plan, name


def test_more_patterns_than_go_into_the_plan(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", i % 5, f"<p>n{i % 5}: v{i}</p>") for i in range(20)], "page_id bigint, url string, schema_id int, html string")
    schemas = spark.range(5).select(F.col("id").cast("int").alias("schema_id")).withColumn("fields", F.array(F.struct(
        F.lit("a").alias("name"), F.lit("").alias("description"), F.lit("text").alias("type"), F.lit(True).alias("required"),
        specs._strings().alias("aliases"), specs._strings().alias("examples")).cast(specs.FIELD_TYPE)))
    rules = schemas.withColumn("rules", F.array(specs._rule("a", "regex_on_text", pattern=F.concat(F.lit("n"), F.col("schema_id"), F.lit(r": (\w+)")))))
    want = [f"v{i}" for i in range(20)]
    for most in (64, 2):
        monkeypatch.setattr(extract, "MOST", most)
        ready = extract.prepare(pages, rules)
        assert bool(ready.schema["compiled"].metadata[extract.KNOWN].get("patterns")) == (most == 64)
        assert [r.results[0].value for r in extract.extract_fields(ready).orderBy("page_id").collect()] == want
        assert "MapInArrow" not in ready._jdf.queryExecution().optimizedPlan().toString()  # no rule reads elements


def test_unfolding_works_an_array_out_once(spark):
    df = spark.createDataFrame([(1, [3, 4]), (2, []), (3, None), (4, [None])], "k int, a array<int>")
    out = unfold(df, ["k"], F.transform("a", lambda x: x + 1), "v", "at")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, 4), (1, 1, 5), (4, 0, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


def test_a_bound_value_is_worked_out_once_and_not_copied(spark):
    """An array around each bound value and a copy of each result were a fifth of the time of the notice queries."""
    twice = let(F.rand(3), lambda x: F.struct(x.alias("a"), x.alias("b"), let(x + 1, lambda y: y - x).alias("c")))
    rows = spark.range(50).select(twice.alias("t"), let(F.lit(None).cast("string"), lambda x: F.coalesce(x, F.lit("none"))).alias("n"))
    got = rows.collect()
    assert all(r.t.a == r.t.b and abs(r.t.c - 1) < 1e-9 and r.n == "none" for r in got) and len({r.t.a for r in got}) > 40
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(" not in plan and plan.count("rand(3)") == 1
