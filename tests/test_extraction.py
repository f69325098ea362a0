import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators import answers, collection, dom, extract, selectors, specs, verify
from pagewright.sources import files, tables

NOTICE = [("title", "text", True, "通知标题", []), ("publish_date", "date", False, "发布时间", ["发布日期"]),
          ("deadline", "date", False, "截止", ["申报截止", "报名截止"]), ("contact", "text", False, "联系", ["联系人"])]


def schema(spark, fields=NOTICE):
    return spark.createDataFrame([("s", [(n, d, t, r, a, []) for n, t, r, d, a in fields])],
                                 f"schema_id string, fields array<{specs.FIELD_TYPE}>")


def run(spark, sources, fields=NOTICE):
    pages = spark.createDataFrame(list(enumerate(sources)), "page_id bigint, html string").withColumn("schema_id", F.lit("s"))
    rows = dom.page_trees(pages, ("page_id", "schema_id", "html")).withColumn("lines", tx.text_lines(F.col("html"))) \
        .withColumn("text", tx.join_lines(F.col("lines")))
    return extract.extract_fields(extract.with_programs(rows, specs.build_programs(schema(spark, fields))))


def page(*lines, title="关于项目申报的通知"):
    return f"<html><head><title>{title}</title></head><body><main><h1>{title}</h1>" + "".join(
        f"<p>{x}</p>" for x in lines) + "</main></body></html>"


def test_notice_with_aliases_and_distractors(spark):
    lines = ["发布日期：2026年6月18日", "申报截止: 2026-06-30", "联系人：张老师，联系电话：010-1"]
    rows = run(spark, [page(*lines), page("资料更新日期：2026年01月01日", *lines), page("- 联系人：李", "发布日期 2026"),
                       page(*lines, title="")]).orderBy("page_id").collect()
    for row in rows[:2]:
        got = {r.field_name: r for r in row.results}
        assert got["title"].normalized_value == "关于项目申报的通知" and got["title"].confidence == 0.81
        assert got["publish_date"].value == "2026年6月18日" and got["publish_date"].normalized_value == "2026-06-18"
        assert got["deadline"].normalized_value == "2026-06-30" and got["contact"].normalized_value.startswith("张老师")
        assert got["contact"].confidence == 0.855 and got["contact"].evidence[0].source == "text_near_label"
        assert row.overall_confidence == pytest.approx((0.81 + 3 * 0.855) / 4, abs=1e-4)
    third = {r.field_name: r for r in rows[2].results}
    # A bullet before the label and a label without a separator are both refused.
    assert third["contact"].status == "missing" and third["publish_date"].status == "missing"
    assert third["contact"].confidence == 0 and third["contact"].strategy == "none"


def test_rules_run_in_order_and_errors_are_kept(spark):
    fields = [("title", "text", True, "t", []), ("name", "text", False, "n", [])]
    rules = F.array(
        specs._rule("title", "css", selector="p"), specs._rule("title", "css", selector="h9"),
        specs._rule("title", "regex_on_text", pattern=r"(?P<v>B\w)"), specs._rule("title", "css", selector="h1"),
        specs._rule("name", "css", selector="p"), specs._rule("name", "xpath", selector="count(//p)"),
        specs._rule("name", "css", selector="h1", enabled=F.lit(False)))
    rows = dom.page_trees(spark.createDataFrame([(1, "<h1>Head</h1><p>A</p><p>Bé x</p>")], "page_id bigint, html string"),
                          ("page_id", "html")).withColumn("lines", tx.text_lines(F.col("html"))) \
        .withColumn("text", tx.join_lines(F.col("lines"))).join(schema(spark, fields)).withColumn("rules", rules)
    title, name = extract.extract_fields(rows).first().results
    assert (title.value, title.strategy, title.evidence[0].start_char) == ("Bé", "regex_on_text", 7)
    assert name.status == "missing" and name.error_message == "ambiguous css selector: p; invalid xpath selector: count(//p)"


def test_only_pages_with_dom_rules_are_parsed(spark):
    pages = spark.createDataFrame([(1, "u", "dom", "<h1>Head</h1><p>name: A</p>"), (2, "u", "text", "<h1>Head</h1><p>name: B</p>"),
                                   (3, "u", "none", "<p>name: C</p>")], "page_id bigint, url string, schema_id string, html string")
    fields = schema(spark, [("name", "text", True, "", []), ("title", "text", False, "", [])]).drop("schema_id")
    rules = {"text": [specs._rule("name", "text_near_label", label="name")],
             "dom": [specs._rule("name", "text_near_label", label="name"), specs._rule("title", "css", selector="h1")]}
    programs = fields.withColumn("schema_id", F.lit("text")).withColumn("rules", F.array(*rules["text"])).unionByName(
        fields.withColumn("schema_id", F.lit("dom")).withColumn("rules", F.array(*rules["dom"])))
    rows = extract.extract_fields(extract.prepare(pages, programs)).orderBy("page_id").collect()
    assert [(r.page_id, [x.value for x in r.results], len(r.nodes) > 0) for r in rows] == [(1, ["A", "Head"], True), (2, ["B", None], False), (3, [], False)]


def test_rules_that_cannot_run_fail_on_their_field_only(spark):
    base = spark.range(1).withColumn("text", F.lit("x: y")).withColumn("lines", F.array(F.lit("x: y"))).join(
        schema(spark, [("a", "text", True, "a", []), ("b", "text", True, "b", [])]))
    good = specs._rule("b", "text_near_label", label="x")
    for rule, error in ((specs._rule("a", "magic"), "unsupported strategy: magic"),
                        (specs._rule("a", "text_near_label", label="x", postprocess=specs._strings("boom")), "unsupported postprocess function: boom"),
                        (specs._rule("a", "regex_on_text", pattern="(x"), "invalid pattern: (x")):
        first, second = extract.extract_fields(base.withColumn("rules", F.array(rule, good))).first().results
        assert (first.status, first.error_message) == ("missing", error) and second.value == "y"


def test_pages_without_a_program_are_kept(spark):
    pages = spark.createDataFrame([(1, "u", "s", "<p>name: A</p>"), (2, "u", "other", "<p>name: B</p>"), (3, "u", None, "<p>name: C</p>")],
                                  "page_id bigint, url string, schema_id string, html string")
    programs = specs.build_programs(schema(spark, [("name", "text", True, "", ["name"])]))
    rows = extract.extract_fields(extract.prepare(pages, programs)).orderBy("page_id").collect()
    assert [(r.page_id, len(r.results), r.program_error) for r in rows] == [
        (1, 1, None), (2, 0, "no program for schema other"), (3, 0, "no program for schema (none)")]


@pytest.mark.parametrize("text,start,end", [("🙂🙂🙂 x42", 4, 7), ("a 🙂 x42 🙂", 4, 7), ("\ue000\ue001🙂x42", 3, 6), ("plain x42", 6, 9)])
def test_offsets_count_characters(spark, text, start, end):
    rules = F.array(specs._rule("a", "regex_on_text", pattern=r"x\d+"))
    row = spark.createDataFrame([(text,)], "text string").withColumn("lines", F.array("text")).join(
        schema(spark, [("a", "text", True, "a", [])])).withColumn("rules", rules)
    found = extract.extract_fields(row).first().results[0].evidence[0]
    assert (found.start_char, found.end_char) == (start, end)


def test_long_attribute_names(spark):
    name = "data-" + "x" * 300
    tree = dom.page_trees(spark.createDataFrame([(1, f'<p {name}="v">t</p>')], "page_id bigint, html string"))
    got = tree.select(selectors.matches(F.col("nodes"), F.col("tokens"), selectors.xpath_selector(F.lit(f"//p/@{name}")),
                                        F.lit(None).cast("string")).alias("m")).first().m
    assert [m.value for m in got] == ["v"]



def results(spark, rows):
    full = [(i, n, v, v, c, e, "text_near_label", s, m) for i, (n, v, c, e, s, m) in enumerate(rows)]
    return spark.createDataFrame([(full,)], f"results array<{extract.RESULT_TYPE}>")


def check(spark, fields, rows):
    got = verify.verify(results(spark, rows).join(schema(spark, fields))).first()
    return [(i.field_name, i.code, i.severity) for i in got.issues], got.report


def ev(text):
    return [("text_near_label", text, 0, 1, 0.85)]


@pytest.mark.parametrize("value", [None, "", " \n", "[]"])
def test_optional_missing_passes(spark, value):
    issues, report = check(spark, [("a", "text", False, "a", [])], [("a", value, 0.0, [], "missing", None)])
    assert issues == [] and report.passed and report.score == 1.0


def test_zero_and_false_are_values(spark):
    issues, _ = check(spark, [("a", "text", True, "a", []), ("b", "text", True, "b", [])],
                      [("a", "0", 0.9, ev("a is 0"), "extracted", None), ("b", "False", 0.9, ev("b False"), "extracted", None)])
    assert issues == []


def test_optional_error_is_one_warning(spark):
    issues, report = check(spark, [("a", "text", False, "a", [])], [("a", None, 0.0, [], "missing", "bad rule")])
    assert issues == [("a", "program_execution_failed", "warning")] and report.passed and report.score == 0.92


def test_missing_required_costs_two_errors(spark):
    issues, report = check(spark, [("a", "text", True, "a", []), ("gone", "text", True, "g", [])],
                           [("a", None, 0.0, [], "missing", None)])
    assert issues == [("a", "required_field_missing", "error"), ("a", "empty_or_low_quality_evidence", "error"),
                      ("gone", "field_not_returned", "error")]
    assert not report.passed and report.score == 0.25


def test_value_checks(spark):
    fields = [("d", "date", True, "d", []), ("n", "number", False, "n", []), ("u", "url", False, "u", []), ("x", "odd", False, "x", [])]
    issues, _ = check(spark, fields, [
        ("d", "2026/6/8", 0.9, ev("on 2026/6/8"), "extracted", None), ("n", "1_0", 0.9, ev("has 1_0"), "extracted", None),
        ("u", "ftp://x", 0.5, ev("elsewhere"), "extracted", None), ("x", "v", 0.9, ev("v v v"), "extracted", None)])
    assert issues == [("d", "field_type_mismatch", "error"), ("d", "date_normalization_failure", "warning"),
                      ("u", "field_type_mismatch", "warning"), ("u", "evidence_not_supporting_value", "warning"),
                      ("u", "low_confidence", "warning")]


def test_dates_may_be_confused(spark):
    fields = [("publish_date", "date", True, "p", []), ("deadline", "date", True, "d", [])]
    row = lambda n, e: (n, "2026-06-08", 0.9, ev(e), "extracted", None)
    assert check(spark, fields, [row("publish_date", "截止 2026-06-08"), row("deadline", "2026-06-08")])[0] == [
        ("publish_date", "publish_date_deadline_confusion", "warning")]
    assert check(spark, fields, [row("publish_date", "on 2026-06-08"), row("deadline", "2026-06-08")])[0] == []


def test_repair_is_tried_once(spark):
    fields = [("a", "date", True, "a", []), ("b", "text", True, "b", []), ("c", "text", True, "c", []), ("d", "text", False, "d", [])]
    rows = [(n, None, 0.0, [], "missing", None) for n in "abc"] + [("d", "ok value", 0.9, ev("ok value"), "extracted", None)]
    base = verify.verify(results(spark, rows).join(schema(spark, fields)).withColumn("overall_confidence", F.lit(0.2)))
    reply = [("a", "2026年1月2日", ("llm_fallback", "2026年1月2日", 0, 5, 0.7), None), ("b", None, None, "timeout")]
    asked = verify.decide_fallback(base).join(spark.createDataFrame([(reply,)], f"answers array<{extract.ANSWER_TYPE}>"))
    done = verify.repair(asked).first()
    by = {r.field_name: r for r in done.results}
    assert (by["a"].status, by["a"].normalized_value, by["a"].confidence) == ("repaired", "2026-01-02", 0.42)
    assert (by["b"].status, by["b"].error_message) == ("fallback_failed", "timeout")
    assert by["c"].error_message == "LLM fallback abstained: required_field_missing" and by["d"].value == "ok value"
    assert {o.field_name: (o.result, o.verified) for o in done.repair_outcomes} == {
        "a": ("repaired", True), "b": ("failed", False), "c": ("abstained", False)}
    assert done.overall_confidence == pytest.approx((0.42 + 0.9) / 4, abs=1e-4) and done.repair_attempts == 1
    again = verify.repair(asked, F.lit(1)).first()
    assert again.repair_status == "repair_skipped" and again.repair_outcomes == [] and again.overall_confidence == 0.2


@pytest.mark.parametrize("content, ok", [
    ('{"a":1}', True), ('```json\n{"a":1}\n```', True), ("```\n{\"a\":1}```", True), ("[1]", False), ("text", False), ('{"a":', False), (None, False)])
def test_answers_must_be_objects(spark, content, ok):
    got = spark.range(1).select(answers.parse_content(F.lit(content).cast("string")).alias("p")).first().p
    assert (got is not None and json.loads(got) == {"a": 1}) == ok


def test_collection_classes(spark):
    cases = [(403, "x", "access_limited"), (468, "", "access_limited"), (404, "x", "server_error"), (200, " ", "empty_page"),
             (None, "x", "unknown"), (200, "x", "usable_content"), (None, "", "empty_page")]
    rows = collection.classify_pages(spark.createDataFrame(cases, "status_code int, text string, want string"))
    assert all(r.classification == r.want for r in rows.collect())


def test_no_success_after_an_access_limit(spark):
    rows = [(1, 1, "r", "server_error", 500, None), (1, 2, "h", "usable_content", 200, None), (2, 1, "r", "access_limited", 403, None),
            (2, 2, "h", "usable_content", 200, None), (3, 1, "r", "network_error", None, "boom"), (3, 2, "h", "empty_page", 200, None)]
    attempts = spark.createDataFrame(rows, "page_id int, attempt_no int, collector string, classification string, http_status int, error_message string")
    got = {r.page_id: (r.collected, r.collector) for r in collection.resolve_attempts(attempts).collect()}
    assert got == {1: (True, "h"), 2: (False, None), 3: (False, None)}
    why = {r.page_id: r.reason for r in collection.failure_reasons(attempts).collect()}
    assert why == {2: "page collection failed; attempts: r: HTTP 403, access_limited: ",
                   3: "page collection failed; attempts: r: HTTP None, network_error: boom | h: HTTP 200, empty_page: empty visible text"}


def test_rule_cleanup_details(spark):
    types = F.create_map(F.lit("d"), F.lit("date"), F.lit("t"), F.lit("text"))
    cases = [
        (specs._rule("d", "regex_on_text", pattern=" (x) ", selector="dropped", postprocess=specs._strings("normalize_date", "evil")),
         dict(pattern="(x)", selector=None, postprocess=["strip", "normalize_whitespace", "normalize_date"])),
        (specs._rule("t", "css", selector="h1", attribute="data-x.y:z"), dict(attribute="data-x.y:z")),
        (specs._rule("t", "text_near_label", label=" L ", labels=specs._strings(*"abcdefghij", "a")), dict(label="L", labels=list("abcdefgh"))),
        (specs._rule("t", "regex_on_text", pattern="(?P<n>a)"), dict(pattern="(?P<n>a)"))]
    for rule, want in cases:
        got = spark.range(1).select(specs.clean_rule(rule, types).alias("c")).first().c
        assert got.issue is None and {k: got.rule[k] for k in want} == want
    for rule in (specs._rule("t", "regex_on_text", pattern="(a"), specs._rule("t", "css", selector="h1", attribute="1x"),
                 specs._rule("t", "css", selector="a" * 501), specs._rule("t", "xpath", selector="/h1")):
        assert "不完整或不安全" in spark.range(1).select(specs.clean_rule(rule, types)["issue"]).first()[0]


def test_page_folder_and_dataset_file(spark, tmp_path):
    (tmp_path / "n_1.html").write_text("<h1>One</h1>\n<p>x</p>", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no")
    assert [(r.item_id, r.html) for r in tables.page_folder(spark, str(tmp_path)).collect()] == [("n_1", "<h1>One</h1>\n<p>x</p>")]
    data = {"name": "d", "items": [{"item_id": "1", "html": "<p/>", "schema_spec": {"name": "s", "fields": [{"name": "t", "type": "text"}]},
                                    "gold_record": {"t": "v"}}, {"item_id": "2", "gold_record": {}}]}
    (tmp_path / "set.json").write_text(json.dumps(data))
    items = tables.labelled_items(spark, str(tmp_path / "set.json"))
    assert items.count() == 2 and [r.item_id for r in tables.items_without_schema(items).collect()] == ["2"]
    with pytest.raises(Exception, match="item without schema: 2"):
        tables.require_schemas(items).collect()


def test_page_files_round_trip(spark, tmp_path):
    """Any text is a file name; keys depend on places only; many small files share splits; a second run changes nothing."""
    rows = [("a", "<p>x</p>\n"), ("b c+d/e%20.é", "é\r\n\x00"), ("", "dropped"), ("_a", "u"), (".b", "v"), ("n", None), (None, "dropped")] + [(f"k{i}", "x" * i) for i in range(300)]
    pages = spark.createDataFrame(rows, "item_id string, html string").repartition(7)
    for _ in range(2):
        written = files.write_page_files(pages, str(tmp_path / "some pages")).collect()
        assert len(written) == len(rows) - 2 == len(list((tmp_path / "some pages").iterdir()))
    got = files.read_page_files(spark, str(tmp_path / "some pages"))
    assert {r.item_id: (r.html, r.bytes) for r in got.collect()} == {
        k: (v, len(v.encode())) for k, v in rows if k and v}
    assert got.rdd.getNumPartitions() < 60
    (tmp_path / "nested/a").mkdir(parents=True)
    (tmp_path / "nested/b").mkdir()
    for name in ("a/x", "b/x", "y"):
        (tmp_path / f"nested/{name}.html").write_text(name)
    nested = files.read_page_files(spark, str(tmp_path / "nested"), nested=True)
    assert {r.item_id: r.html for r in nested.collect()} == {n: n for n in ("a/x", "b/x", "y")}
    assert [r.item_id for r in files.read_page_files(spark, str(tmp_path / "nested")).collect()] == ["y"]
