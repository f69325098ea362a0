import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagewright.operators import answers, evaluate, iterations, skew, telemetry
from pagewright.sources import sinks, tables
from pagewright.streaming import events as stream


def test_scoring_record(spark):
    fields = [(n, "text") for n in "abc"]
    df = spark.createDataFrame([("Ours Full", "1", "completed", {"a": "ok", "b": "wrong"}, {"a": "ok", "b": "ok"}, ["a", "b", "c"], fields,
                                 {"a": 0.9, "b": 0.1}, 0)],
                               "method string, item_id string, status string, predicted map<string,string>, gold map<string,string>, "
                               "required array<string>, fields array<struct<name:string,type:string>>, field_confidences map<string,double>, "
                               "model_call_count int")
    got = evaluate.score_methods(evaluate.as_records(df)).first()
    assert got.selective_accuracy == 1 and got.required_field_missing_rate == 0.3333 and got.field_accuracy == 0.5
    assert got.estimated_token_cost == 0 and got.metric_sources["estimated_token_cost"] == "measured"
    assert got.repair_success_rate is None and "repair_success_rate" in got.unavailable_reasons
    # 2 + 3 checks: keys declared, not complete, a and b typed, c absent.
    assert got.schema_adherence == pytest.approx(0.6) and got.evidence_precision is None and got.evidence_coverage is None


def test_evidence_precision_needs_annotations(spark):
    df = spark.createDataFrame([("Program Only", "1", {"a": True, "b": False}, 3, True), ("Program Only", "2", {"a": True}, 0, False)],
                               "method string, item_id string, annotations map<string,boolean>, evidenced_fields int, program_reused boolean")
    got = evaluate.score_methods(evaluate.as_records(df)).first()
    assert got.evidence_precision == 0.5 and got.program_reuse_rate == 0.5 and got.field_accuracy is None
    assert got.unavailable_reasons["field_accuracy"] == "no eligible annotated fields or schema checks"


def test_failures_stay_with_their_items(spark):
    df = evaluate.as_records(spark.createDataFrame([("Direct LLM", "1", "failed", ["Direct LLM: no key"]), ("Direct LLM", "2", "completed", [])],
                                                   "method string, item_id string, status string, errors array<string>"))
    got = evaluate.score_methods(df).first()
    assert (got.sample_count, got.success_count, got.failure_count) == (2, 1, 1)
    assert [(r.item_id, r.errors) for r in evaluate.sample_errors(df).collect()] == [("1", ["Direct LLM: no key"])]


def test_token_usage_is_null_once_a_call_lacks_it(spark):
    calls = spark.createDataFrame([(True, 10, 4), (True, 20, None), (False, None, None)],
                                  "http_attempted boolean, actual_input_tokens int, actual_output_tokens int") \
        .withColumn("estimated_input_tokens", F.lit(1)).withColumn("estimated_output_tokens", F.lit(1))
    got = answers.token_metrics(calls).first()
    assert (got.model_call_count, got.token_usage_missing_calls, got.actual_input_tokens, got.actual_output_tokens) == (2, 1, None, None)
    assert (got.partial_actual_input_tokens, got.partial_actual_output_tokens) == (30, 4)


def test_empty_window_is_unavailable_not_zero(spark):
    runs = spark.createDataFrame([], "status string, runtime_ms double, queue_wait_ms double, metrics map<string,"
                                     f"{evaluate.ENVELOPE}>")
    got = telemetry.summarize_runs(runs).first()
    assert got.total == 0 and got.p50_runtime_ms is None and got.failure_rate is None
    assert {r.source for r in telemetry.metric_summary(runs).collect()} == {"unavailable"}


def test_window_bounds_and_roots(spark):
    now = dt.datetime(2026, 1, 10)
    rows = [(1, now - dt.timedelta(hours=1), None), (2, now - dt.timedelta(hours=1), 1), (3, now - dt.timedelta(hours=800), None)]
    runs = spark.createDataFrame(rows, "task_id int, created_at timestamp, parent_task_id int")
    assert [r.task_id for r in telemetry.recent_roots(runs, F.lit(now), 5000).collect()] == [1]


def run(task, quality=0.8, missing=0.0, ms=100.0, **other):
    def m(value, source="measured"):
        return (value, source, "ratio", 1, None)

    fp = {"page_hash": "h", "schema_signature": "s", "model": "m", "model_endpoint_hash": "e", "enable_field_repair": False,
          "reuse_verified_program": False, "program_spec_mode": "create", "evaluator_version": "2", **other.pop("fp", {})}
    return (task, other.get("status", "completed"), "extraction", ms, fp,
            {"verification_score": m(quality), "field_completion_rate": m(quality), "evidence_coverage": m(quality, other.get("source", "measured")),
             "required_field_missing_rate": m(missing)}, "2")


@pytest.mark.parametrize("candidate, status, reason", [
    (run("b", 0.9), "accepted", "quality improvement meets"), (run("b", 0.805), "rejected", "quality improvement is below"),
    (run("b", 0.9, 0.1), "rejected", "quality guardrail regression: required_field_missing_rate"),
    (run("b", 0.9, ms=130.0), "rejected", "latency regression"), (run("b", 0.9, fp={"page_hash": "x"}), "blocked", "incomparable fingerprints: page_hash"),
    (run("b", 0.9, source="estimated"), "blocked", "guardrail measurements unavailable: candidate.evidence_coverage"),
    (run("b", 0.9, ms=None), "blocked", "quality or runtime metric unavailable")])
def test_iteration_decisions(spark, candidate, status, reason):
    fp = ("struct<page_hash:string,schema_signature:string,model:string,model_endpoint_hash:string,enable_field_repair:boolean,"
          "reuse_verified_program:boolean,program_spec_mode:string,evaluator_version:string>")
    runs = spark.createDataFrame([run("a"), candidate], f"task_id string, status string, workflow_type string, runtime_ms double, fingerprint {fp}, "
                                                        f"metrics map<string,{evaluate.ENVELOPE}>, metrics_version string")
    asked = spark.createDataFrame([("i", "x", "a", "b", None)], "iteration_id string, experiment_id string, baseline_run_id string, "
                                                               "candidate_run_id string, parent_iteration_id string")
    got = iterations.evaluate_iterations(asked, runs).first()
    assert got.error is None and got.status == status and got.decision_reason.startswith(reason)
    if status == "accepted":
        assert got.metric_deltas["quality_proxy"] == pytest.approx(0.1) and got.metric_deltas["evidence_coverage"] == pytest.approx(0.1)


def test_positions_on_both_paths(spark):
    # One key owns most rows, many rows share a time stamp.
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"),
                                      (F.col("id") % 50).alias("t"), "id")
    plain = skew.with_position(rows, ["k"], [F.col("t"), F.col("id")], "p")
    ranged = skew.with_position(rows, ["k"], [F.col("t"), F.col("id")], "p", key_rows=100)
    assert plain.exceptAll(ranged).count() == 0 and ranged.count() == 20_000


@pytest.mark.parametrize("shape", ["(id*7919)%5003/10.0D", "IF(id%3=0, 42.0D, id*1.0D)", "pow(1.002D, id%9000)", "5.0D"])
def test_percentiles_on_both_paths(spark, shape):
    rows = spark.range(9_001).selectExpr("CASE WHEN id % 20 = 0 THEN 'small' ELSE 'big' END AS k", f"{shape} AS v")
    points = [0.0, 0.5, 0.95, 0.99, 1.0]
    want = {r.k: (r.n, r.percentiles) for r in skew.percentiles(rows, ["k"], "v", points).collect()}
    got = {r.k: (r.n, r.percentiles) for r in skew.percentiles(rows, ["k"], "v", points, key_rows=40, accuracy=200).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12)


def test_salted_lookup_keeps_every_row(spark):
    big = spark.range(5_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    side = spark.range(4_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    plain = big.join(side, "k", "left")
    salted = skew.attach(big, side, "k", rows=10, hot_rows=100, salts=8)
    assert salted.columns == plain.columns and plain.exceptAll(salted).count() == 0 and salted.count() == 5_000


def test_keyed_sink_and_append(spark, tmp_path):
    path = str(tmp_path / "results")
    def write(rows):
        sinks.upsert_parquet(spark.createDataFrame(rows, "task_id int, value string, written_at int"), path, ["task_id"], buckets=4)
    write([(1, "a", 1), (2, "b", 1), (1, "c", 2)])
    write([(1, "late", 1), (3, "d", 1), (2, "e", 5)])
    assert sorted((r.task_id, r.value) for r in sinks.read_upserted(spark, path).collect()) == [(1, "c"), (2, "e"), (3, "d")]
    assert [r.value for r in tables.stored(sinks.read_upserted(spark, path), "task_id", 3).collect()] == ["d"]
    log = str(tmp_path / "reviews")
    for n in (1, 2):
        sinks.append(spark.range(n), log)
    assert spark.read.parquet(log).count() == 3


def test_older_files_get_defaults(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "v=1"))
    spark.range(1).withColumn("score", F.lit(None).cast("double")).write.parquet(str(tmp_path / "v=2"))
    got = tables.read_versions(spark, str(tmp_path), defaults={"score": ("double", 0.5), "note": ("string", "-")})
    assert [(r.score, r.note) for r in got.collect()] == [(0.5, "-")] * 3


def test_payloads(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("junk",)], "p string")
    assert [r.x and r.x.a for r in rows.select(tables.load_payload(F.col("p"), "a int").alias("x")).collect()] == [1, None, None]


def test_stream_state_survives_restarts_and_replays(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    def feed(rows):
        spark.createDataFrame(rows, stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream.write_latest(stream.read_events(spark, source), table, state).awaitTermination()
        return {r.task_id: r.status for r in sinks.read_upserted(spark, table).collect()}
    t = dt.datetime(2026, 1, 1)
    assert feed([(1, 7, 1, "s", "running", t, 1.0), (2, 7, 2, "f", "failed", t, 1.0), (3, 8, 1, "s", "running", t, 1.0)]) == {7: "failed", 8: "running"}
    # A later non-terminal event does not reopen a finished task.
    assert feed([(4, 7, 9, "s", "running", t, 1.0), (5, 8, 2, "f", "completed", t, 1.0)]) == {7: "failed", 8: "completed"}


def test_running_latest_state_in_update_mode(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 7, 1, "s", "completed", t, 1.0), (2, 7, 5, "s", "running", t, 1.0)], stream.EVENT_SCHEMA).write.parquet(source)
    seen = []
    stream.latest_states(stream.read_events(spark, source)).writeStream.outputMode("update") \
        .foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "s")) \
        .trigger(availableNow=True).start().awaitTermination()
    assert [(r.task_id, r.status, r.events) for r in seen] == [(7, "completed", 2)]


def test_page_queries_do_not_shuffle(spark, folder):
    """With enough splits, everything from page to verified record stays on the page's row."""
    import contextlib
    import io

    from pagewright.operators import body, dom, intent
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        body.select_body(intent.assess_intent(dom.page_trees(pages))).select("page_id", "intent", "body").explain("formatted")
    assert "Exchange" not in plan.getvalue() and "ReadSchema: struct<page_id:bigint,html:string>" in plan.getvalue()


def test_missing_keys_survive_on_every_path(spark):
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("k"), (F.col("id") % 50).alias("t"), "id")
    plain = skew.with_position(rows, ["k"], [F.col("t"), F.col("id")], "p")
    ranged = skew.with_position(rows, ["k"], [F.col("t"), F.col("id")], "p", key_rows=10)
    assert ranged.count() == 600 and plain.exceptAll(ranged).count() == 0
    side = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for how in ("left", "inner"):
        want = rows.join(side, "k", how)
        for hot in (10, 10_000):
            got = skew.attach(rows, side, "k", how, rows=1, hot_rows=hot, salts=4)
            assert got.count() == want.count() and want.exceptAll(got).count() == 0
    empty = rows.filter("id < 0")
    assert skew.attach(empty, side, "k", rows=1).count() == 0 and skew.with_position(empty, ["k"], [F.col("id")], "p", key_rows=1).count() == 0


def test_node_without_a_name_is_summarised(spark):
    nodes = spark.createDataFrame([(n, float(i), "success") for i, n in enumerate(["a", None, "a", None, None])], "node string, runtime_ms double, status string")
    for key_rows in (100, 1):
        got = {r.node: (r.average_runtime_ms, r.sample_count) for r in telemetry.node_summary(nodes, key_rows).collect()}
        assert got == {"a": (1.0, 2), None: (pytest.approx(8 / 3), 3)}


def test_evidence_precision_counts_the_larger_side_of_each_record(spark):
    """Two records with one evidenced field and three annotations each, two of them right."""
    fields = [(n, "text") for n in "abc"]
    rows = [("Ours Full", str(i), "completed", {"a": "ok"}, {"a": "ok"}, ["a"], fields, {"a": 0.9}, 0, 1, {"a": True, "b": True, "c": False}) for i in range(2)]
    df = spark.createDataFrame(rows, "method string, item_id string, status string, predicted map<string,string>, gold map<string,string>, "
                                     "required array<string>, fields array<struct<name:string,type:string>>, field_confidences map<string,double>, "
                                     "model_call_count int, evidenced_fields bigint, annotations map<string,boolean>")
    got = evaluate.score_methods(evaluate.as_records(df)).first()
    assert got.sample_count == 2 and got.evidence_precision == 0.6667
