import random

from pyspark.sql import functions as F

from pagewright.operators import alignment, answers, evaluate
from pagewright.operators.specs import FIELD_TYPE

FIELD = "name string, aliases array<string>"


def test_keys_align_one_to_one_best_first(spark):
    def pairs(keys, fields):
        df = spark.createDataFrame([(keys, fields)], f"keys array<string>, fields array<struct<{FIELD}>>")
        got = df.select(alignment.align(F.col("keys"), F.col("fields")).alias("p")).first().p
        return got and {(p.field_name, p.key): round(p.score, 4) for p in got}

    assert pairs(["Title", "title"], [("title", [])]) == {("title", "title"): 1.0}
    # A field's very name goes before an alias of an earlier field.
    assert pairs(["title", "pageTitle"], [("headline", ["title"]), ("title", [])]) == {("title", "title"): 1.0}
    assert pairs(["publish date", "Author-Name", "x"], [("publish_date", None), ("author", ["author name"]), ("y", [])]) == {
        ("publish_date", "publish date"): 1.0, ("author", "Author-Name"): 0.9}
    # One key cannot serve two fields; the pair with more words in common wins.
    assert pairs(["release_date"], [("date", []), ("release_date_utc", [])]) == {("release_date_utc", "release_date"): 0.6667}
    assert not pairs([], [("a", [])]) and not pairs(["a"], []) and not pairs(None, [("a", [])])
    assert pairs(["", "__"], [("", []), ("a", [])]) == {("", ""): 1.0}
    assert pairs(["日付"], [("date", ["日付"])]) == {("date", "日付"): 0.9}


def test_open_records_take_field_names(spark):
    content = ['```json\n{"record":{"pageTitle":"T","site":"s","note":null},"evidence":{"pageTitle":{"text":"T","confidence":"2"}}}\n```',
               "sorry", None, '{"a":1,"a":2}', "{}", '{"page_title":"flat"}']
    fields = F.array(F.struct(F.lit("page_title").alias("name"), F.lit("").alias("description"), F.lit("text").alias("type"), F.lit(True).alias("required"),
                              F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("examples")).cast(FIELD_TYPE))
    df = spark.createDataFrame(list(enumerate(content)), "page_id bigint, content string")
    rows = df.select("page_id", alignment.rename(answers.open_record(F.col("content")), fields).alias("e")).orderBy("page_id").collect()
    assert [[tuple(x) for x in r.e] if r.e is not None else None for r in rows] == [
        [("page_title", "T", 1.0, "T"), ("site", "s", 0.0, None), ("note", None, 0.0, None)], None, None, None, [], [("page_title", "flat", 0.0, None)]]


def test_failed_runs_keep_costs_and_lose_points(spark):
    rows = spark.createDataFrame([(1, '{"record":{"a":"x"}}', 5), (2, "no", 7), (3, '{"record":{"a":"z"}}', 0)], "page_id bigint, content string, runtime_ms int")
    rows = rows.withColumns({"method": F.lit("Direct LLM"), "results": evaluate.direct_results(answers.open_record(F.col("content"))),
                             "error": answers.content_error(F.col("content")), "fields": F.expr("array(named_struct('name','a','type','text','required',true))"),
                             "model_call_count": F.lit(1)})
    gold = rows.select("page_id", F.create_map(F.lit("a"), F.lit("x")).alias("gold"))
    records = evaluate.to_records(rows.withColumn("overall_confidence", evaluate.mean_confidence(F.col("results"))), gold)
    got = evaluate.score_methods(records).first()
    assert (got.sample_count, got.success_count, got.failure_count, got.runtime_ms, got.model_call_count) == (3, 2, 1, 12, 3)
    assert got.field_accuracy == 0.3333 and got.required_field_missing_rate == 0.3333
    assert [(r.item_id, r.errors) for r in evaluate.sample_errors(records).collect()] == [("2", ["Direct LLM: answer is not a JSON object"])]


def test_spans_equal_all_pairs(spark):
    rng = random.Random(3)

    def rows(n):
        out = []
        for i in range(n):
            start = rng.choice([None, *[rng.randrange(0, 900)] * 20])
            out.append((rng.randrange(4), rng.choice("ab"), start, None if rng.random() < 0.03 else (start or 0) + rng.choice([0, 1, 7, 60, 700, -3]), i))
        return out

    spans, marks = rows(300), rows(300)
    shape = "page_id int, field_name string, start_char int, end_char int"
    left = spark.createDataFrame(spans, shape + ", no int")
    right = spark.createDataFrame(marks, shape + ", no int").drop("no")
    for bucket in (16, 256, 100_000):
        got = alignment.matched_spans(left, right, "page_id", bucket=bucket)
        got = sorted((r.no, r.mark.start_char, r.mark.end_char) for r in got.collect())
        want = []
        for p, f, s, e, no in spans:
            for q, g, t, u, _ in marks:
                if (p, f) == (q, g) and None not in (s, e, t, u) and s < e and t < u:
                    common = min(e, u) - max(s, t)
                    if common > 0 and common >= 0.5 * (u - t):
                        want.append((no, t, u))
        assert got == sorted(want) and want


def test_annotations_of_items_with_marks(spark):
    records = spark.createDataFrame([("A", 1), ("B", 1), ("A", 2)], "method string, page_id int")
    spans = spark.createDataFrame([("A", 1, "x", 0, 10), ("B", 1, "x", 9, 10), ("A", 2, "x", 0, 5)], "method string, page_id int, field_name string, start_char int, end_char int")
    marks = spark.createDataFrame([(1, "x", 5, 10), (1, "y", 0, 3), (1, None, 0, 1), (9, "x", 0, 1)], "page_id int, field_name string, start_char int, end_char int")
    got = {(r.method, r.page_id): r.annotations for r in alignment.annotate(records, spans, marks, "page_id").collect()}
    assert got == {("A", 1): {"x": True, "y": False}, ("B", 1): {"x": False, "y": False}, ("A", 2): None}
    empty = alignment.annotate(records, spans.limit(0), marks.limit(0), "page_id").collect()
    assert [r.annotations for r in empty] == [None] * 3
