"""Analytics over the run-event log and run snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .answers import token_metrics
from .evaluate import ENVELOPE
from .extract import effective
from .skew import KEY_ROWS, attach, percentiles, with_position
from .verify import is_missing

# States and the metric names of each kind of average.
TERMINAL = ("completed", "failed")
STATES = ("queued", "running", "completed", "failed")
METRICS_VERSION = "2"
MEANS = ("verification_score", "verification_passed", "evidence_coverage", "program_reuse",
         "page_intent_confidence", "body_visible_text_coverage", "body_block_coverage",
         "body_continuity_score", "body_noise_ratio")
WEIGHTED = ("browser_launch_success_rate", "collection_success_rate", "required_field_missing_rate",
            "optional_field_missing_rate", "field_completion_rate", "repair_supported_rate")
SUMS = ("collection_attempt_count", "fallback_attempt_count", "access_limited_count", "schema_failure_count",
        "model_call_count", "token_usage_missing_calls", "selector_attempt_count", "selector_ambiguity_count",
        "selector_error_count", "program_rule_rejection_count", "body_candidate_count",
        "body_merged_candidate_count", "program_reuse_reason_count", "browser_wait_ms")


def envelope(value: Column, count: Column | None = None, unit: str = "", source: Column | None = None,
             reason: str = "no eligible samples") -> Column:
    """Value with its provenance; a null value is unavailable and says why."""
    known = value.isNotNull()
    measured = F.lit("measured") if source is None else source
    return F.struct(
        value.cast("double").alias("value"), F.when(known, measured).otherwise("unavailable").alias("source"),
        F.lit(unit).alias("unit"), (F.lit(1) if count is None else count).cast("bigint").alias("sample_count"),
        F.when(~known, F.lit(reason)).alias("reason")).cast(ENVELOPE)


def ratio(part: Column, whole: Column) -> Column:
    return envelope(F.try_divide(part.cast("double"), whole.cast("double")), whole, "ratio")


# -- event log -------------------------------------------------------------------------------

def assign_sequence(events: DataFrame, key: str = "task_id", ts: str = "ts", tie: str = "event_id",
                    key_rows: int = KEY_ROWS) -> DataFrame:
    """Increasing number of each event within its task."""
    return with_position(events, [key], [F.col(ts), F.col(tie)], "sequence", key_rows)


def continue_sequence(stored: DataFrame, fresh: DataFrame, key: str = "task_id", ts: str = "ts", tie: str = "event_id",
                      key_rows: int = KEY_ROWS) -> DataFrame:
    """Numbers for new events that go on where each task's stored ones end.

    Stored events are not numbered again: only their largest number per task is read.
    """
    ends = stored.groupBy(key).agg(F.max("sequence").alias("_end")).withColumnRenamed(key, "_task")
    numbered = assign_sequence(fresh, key, ts, tie, key_rows)
    return numbered.join(ends, F.col(key).eqNullSafe(F.col("_task")), "left").withColumn(
        "sequence", F.col("sequence") + F.coalesce("_end", F.lit(0))).drop("_task", "_end")


def page_after(events: DataFrame, task_id, cursor: int = 0, size: int = 200) -> DataFrame:
    """Next page of one task's events in order, with the cursor to continue from."""
    return events.filter((F.col("task_id") == F.lit(task_id)) & (F.col("sequence") > cursor)) \
        .orderBy("sequence").limit(size)


def next_cursor(page: DataFrame, cursor: int = 0) -> DataFrame:
    return page.agg(F.coalesce(F.max("sequence"), F.lit(cursor)).alias("next_cursor"))


def latest_state(events: DataFrame, *payload: str, key: str = "task_id") -> DataFrame:
    """Latest snapshot per task; a terminal state is never replaced by a non-terminal one."""
    rank = F.struct(F.col("status").isin(*TERMINAL), F.col("sequence"))
    return events.groupBy(key).agg(
        F.max_by(F.struct("status", "sequence", *payload), rank).alias("s"),
        F.count("*").alias("event_count")).select(key, "s.*", "event_count")


def node_runs(events: DataFrame) -> DataFrame:
    """Pair node start and finish per (task, node)."""
    started, finished = F.col("event_type") == "node_started", F.col("event_type") == "node_finished"
    return events.filter(started | finished).groupBy("task_id", "node").agg(
        F.min(F.when(started, F.col("ts"))).alias("start_time"),
        F.min(F.when(finished, F.col("ts"))).alias("end_time"),
        F.min_by("status", F.when(finished, F.col("sequence"))).alias("_end"),
        F.min_by("runtime_ms", F.when(finished, F.col("sequence"))).alias("runtime_ms"),
    ).withColumn("status", F.coalesce("_end", F.lit("running"))).drop("_end")


def task_progress(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of finished nodes; a task without nodes is complete. ``totals``: task_id, total_nodes."""
    done = nodes.groupBy("task_id").agg(F.count_if(F.col("status").isin("success", "skipped")).alias("done"))
    return totals.join(done, "task_id", "left").select(
        "task_id", "total_nodes", F.coalesce("done", F.lit(0)).alias("completed_nodes"),
        F.when(F.col("total_nodes") > 0, F.round(
            100.0 * F.coalesce("done", F.lit(0)) / F.col("total_nodes"), 1)).otherwise(100.0).alias("progress"))


def close_nodes(expected: DataFrame, nodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Nodes of finished tasks that never finished, as skipped rows with the reason."""
    ended = nodes.filter(F.col("end_time").isNotNull()).select("task_id", "node")
    finished = tasks.filter(F.col("status").isin(*TERMINAL)).select("task_id", F.col("status").alias("_task"))
    return expected.join(ended, ["task_id", "node"], "left_anti").join(finished, "task_id").select(
        "task_id", "node", F.lit("skipped").alias("status"),
        F.when(F.col("_task") == "failed", "upstream failure").otherwise("not required").alias("output_summary"))


def interrupted(events: DataFrame) -> DataFrame:
    """Tasks without a terminal event, marked failed."""
    ended = events.groupBy("task_id").agg(F.max(F.col("status").isin(*TERMINAL)).alias("_ended"))
    return ended.filter(~F.col("_ended")).select(
        "task_id", F.lit("failed").alias("status"), F.lit(0.0).alias("runtime_ms"),
        F.array(F.lit("backend restart interrupted task")).alias("errors"))


def retry_receipts(runs: DataFrame, requests: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """What happens to each retry request (request_id, original_task_id, requested_at).

    Only failed runs with a retained input may be retried; a retry keeps the correlation id and
    gets the next attempt number of it.
    """
    original = runs.select(
        F.col("task_id").alias("original_task_id"), "correlation_id", "workflow_type",
        F.col("status").alias("_status"), F.col("input_retained").alias("_kept"))
    joined = attach(requests, original, "original_task_id")
    # Results are compared by these texts.
    problem = F.when(F.col("_status").isNull(), "run not found") \
        .when(F.col("_status") != "failed", "only failed runs can be retried") \
        .when(~F.col("_kept"), "run input was not retained; retry is unavailable")
    judged = joined.withColumn("error", problem).drop("_status", "_kept")
    accepted = with_position(judged.filter("error is null"), ["correlation_id"],
                             [F.col("requested_at"), F.col("request_id")], "attempt", key_rows)
    return accepted.unionByName(judged.filter("error is not null").withColumn(
        "attempt", F.lit(None).cast("bigint")))


def queue_wait_ms(created: Column, started: Column) -> Column:
    micros = F.unix_micros(started.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / 1000.0)


# -- run metrics -----------------------------------------------------------------------------

def run_metrics(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``metrics`` (MAP name -> envelope), ``metrics_version`` and ``fingerprint`` to runs.

    ``runs``: one row per task with fields, results, report, issues, intent, body, structure,
    rules, fallback flags and elapsed_ms (null structs where a stage did not run). ``events``:
    the log with a ``details`` map.
    """
    d = F.col("details")

    def detail(name, kind="string"):
        return F.try_element_at(d, F.lit(name)).cast(kind)

    def of(kind):
        return F.col("event_type") == kind

    attempt, probe, selector = of("collection_attempt"), of("browser_probe"), of("selector_execution")
    repaired = of("field_repair")

    def true(kind, name, value="true"):
        return F.count_if(of(kind) & (detail(name) == value))

    counted = events.groupBy("task_id").agg(
        F.count_if(attempt).alias("attempts"), true("collection_attempt", "result", "success").alias("attempts_ok"),
        true("collection_attempt", "fallback_attempted").alias("attempts_fallback"),
        true("collection_attempt", "classification", "access_limited").alias("limited"),
        F.count_if(probe).alias("probes"), true("browser_probe", "launch_verified").alias("probes_ok"),
        F.sum(F.when(probe, F.coalesce(detail("post_navigation_wait_ms", "double"), F.lit(0.0)))).alias("waited"),
        F.count_if(selector).alias("selectors"),
        true("selector_execution", "result", "ambiguous_matches").alias("ambiguous"),
        true("selector_execution", "result", "invalid_selector").alias("invalid"),
        F.count_if(of("program_rule_rejected")).alias("rejections"),
        F.count_if(repaired).alias("repairs"), true("field_repair", "verified").alias("repairs_ok"),
        F.count_if(of("node_finished") & (F.col("node") == "schema_agent_node")
                   & (F.col("status") == "failed")).alias("schema_failures"))
    calls = events.filter(of("model_call")).select(
        "task_id", detail("http_attempted", "boolean").alias("http_attempted"),
        *[detail(n, "bigint").alias(n) for n in (
            "actual_input_tokens", "actual_output_tokens", "estimated_input_tokens", "estimated_output_tokens")])
    joined = runs.join(counted, "task_id", "left").join(token_metrics(calls, "task_id"), "task_id", "left")
    return joined.withColumn("metrics", _metric_map()).withColumn("metrics_version", F.lit(METRICS_VERSION)) \
        .select(*runs.columns, "metrics", "metrics_version", fingerprint_of(runs).alias("fingerprint"))


def _metric_map() -> Column:
    def n(name):
        return F.coalesce(F.col(name), F.lit(0))

    def value_of(name):
        return effective(F.get(F.filter("results", lambda r: r["field_name"] == name), F.lit(0)))

    def lacking(test):
        kept = F.filter("fields", test)
        return F.size(F.filter(kept, lambda f: is_missing(value_of(f["name"])))), F.size(kept)

    has_schema, has_results = F.col("fields").isNotNull(), F.coalesce(F.size("results"), F.lit(0)) > 0
    shown = F.filter("results", lambda r: ~is_missing(effective(r)))
    declared = F.coalesce(F.size("fields"), F.lit(0))
    need, need_all = lacking(lambda f: f["required"])
    want, want_all = lacking(lambda f: ~f["required"])
    gone, _ = lacking(lambda f: F.lit(True))
    total = F.aggregate("results", F.lit(0.0), lambda acc, r: acc + r["confidence"])
    report = F.col("report").isNotNull()
    zero = F.lit(0)

    def opt(flag, value, count=None):
        return envelope(F.when(flag, value), flag.cast("int") if count is None else count)

    body, intent = F.col("body"), F.col("intent")
    entries = {
        "workflow_runtime_ms": envelope(F.col("elapsed_ms"), unit="ms"),
        "collection_attempt_count": envelope(n("attempts")),
        "browser_launch_success_rate": ratio(n("probes_ok"), n("probes")),
        "collection_success_rate": ratio(n("attempts_ok"), n("attempts")),
        "fallback_attempt_count": envelope(n("attempts_fallback")),
        "access_limited_count": envelope(n("limited")),
        "schema_failure_count": envelope(n("schema_failures")),
        "schema_field_count": opt(has_schema, declared),
        "extracted_field_count": opt(has_results, F.size(shown), F.coalesce(F.size("results"), zero)),
        "required_field_missing_rate": ratio(F.coalesce(need, zero), F.coalesce(need_all, zero)),
        "optional_field_missing_rate": ratio(F.coalesce(want, zero), F.coalesce(want_all, zero)),
        "field_completion_rate": ratio(F.coalesce(declared - gone, zero), declared),
        "selector_attempt_count": envelope(n("selectors")),
        "selector_ambiguity_count": envelope(n("ambiguous")),
        "selector_error_count": envelope(n("invalid")),
        "program_rule_rejection_count": envelope(n("rejections")),
        "browser_wait_ms": envelope(F.when(n("probes") > 0, F.col("waited")), n("probes"), "ms"),
        "evidence_coverage": ratio(F.coalesce(F.size(F.filter(shown, lambda r: F.size(r["evidence"]) > 0)), zero),
                                   F.coalesce(F.size(shown), zero)),
        "average_confidence": opt(has_results, total / F.size("results"), F.coalesce(F.size("results"), zero)),
        "verification_score": opt(report, F.col("report.score")),
        "verification_passed": opt(report, F.col("report.passed").cast("int")),
        "verification_issue_count": opt(report, F.size("issues")),
        "repair_attempt_count": envelope(n("repairs")),
        "repair_supported_rate": ratio(n("repairs_ok"), n("repairs")),
        "program_reuse": opt(F.col("rules").isNotNull(), F.coalesce("program_reused", F.lit(False)).cast("int")),
        "page_intent_confidence": opt(intent.isNotNull(), intent["confidence"]),
        "body_visible_text_coverage": opt(body.isNotNull(), body["visible_text_coverage"]),
        "body_block_coverage": opt(body.isNotNull(), body["block_coverage"]),
        "body_continuity_score": opt(body.isNotNull(), body["continuity_score"]),
        "body_noise_ratio": opt(body.isNotNull(), body["noise_ratio"]),
        "body_candidate_count": opt(body.isNotNull(), body["candidate_count"]),
        "body_merged_candidate_count": opt(body.isNotNull(), body["merged_candidate_count"]),
        "program_reuse_reason_count": envelope(
            F.coalesce(F.size("program_reuse_reasons"), zero), F.col("program_reuse_decision").isNotNull().cast("int")),
        "queue_wait_ms": envelope(F.col("queue_wait_ms"), unit="ms"),
    }
    calls = n("model_call_count")
    lost = "provider usage missing for one or more calls"
    for name in ("model_call_count", "token_usage_missing_calls", "partial_actual_input_tokens",
                 "partial_actual_output_tokens"):
        entries[name] = envelope(n(name), calls, reason=lost)
    for name in ("actual_input_tokens", "actual_output_tokens"):
        known = F.when(calls == 0, zero).otherwise(F.col(name))
        entries[name] = envelope(known, calls, reason=lost)
    for name in ("estimated_input_tokens", "estimated_output_tokens"):
        entries[name] = envelope(n(name), calls, source=F.when(calls > 0, "estimated").otherwise("measured"),
                                 reason=lost)
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def fingerprint_of(runs: DataFrame) -> Column:
    """What a run depended on; two runs are comparable only when these agree."""
    def given(name, default, kind="string"):
        col = F.col(name) if name in runs.columns else F.lit(None)
        return F.coalesce(col.cast(kind), F.lit(default)).alias(name)

    def text(name):
        return (F.col(name) if name in runs.columns else F.lit(None)).cast("string").alias(name)

    reasons = F.coalesce("program_reuse_reasons", F.array().cast("array<string>"))
    return F.struct(
        text("page_hash"), text("schema_signature"), text("program_signature"), text("model"),
        text("model_endpoint_hash"), given("enable_field_repair", False, "boolean"),
        given("program_spec_mode", "create"), given("reuse_verified_program", False, "boolean"),
        F.col("intent.intent").alias("page_intent"),
        F.when(F.col("structure").isNotNull(), F.sha2(F.to_json("structure"), 256))
        .alias("page_structure_signature"),
        given("program_reuse_decision", "not_requested"), reasons.alias("program_reuse_reasons"),
        F.when(F.col("fields").isNotNull(), "extraction").otherwise("unknown").alias("workflow_type"),
        F.lit("2").alias("evaluator_version"))


# -- window summaries ------------------------------------------------------------------------

def recent_roots(runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Root runs created in the last ``hours`` (held within 1..720)."""
    span = min(720, max(1, hours))
    return runs.filter((F.col("created_at") >= now - F.make_interval(hours=F.lit(span)))
                       & F.col("parent_task_id").isNull())


def summarize_runs(runs: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Counts by state, exact runtime percentiles, failure rate and mean queue wait: one row."""
    ended = F.col("status").isin(*TERMINAL)
    base = runs.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATES],
        F.avg(F.when(ended, F.col("runtime_ms"))).alias("average_runtime_ms"),
        F.count_if(ended).alias("terminal"),
        F.try_divide(F.count_if(F.col("status") == "failed").cast("double"),
                     F.count_if(ended).cast("double")).alias("failure_rate"),
        F.avg("queue_wait_ms").alias("average_queue_wait_ms"))
    tails = percentiles(runs.filter(ended), [], "runtime_ms", [0.5, 0.95, 0.99], key_rows)
    # Two one-row frames side by side.
    rows = base.unionByName(tails, allowMissingColumns=True)
    both = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    p = F.col("percentiles")
    return both.select(
        "total", *STATES, "terminal", F.col("n").alias("runtime_samples"), "average_runtime_ms",
        *[F.get(p, F.lit(i)).alias(f"p{q}_runtime_ms") for i, q in enumerate((50, 95, 99))],
        "failure_rate", "average_queue_wait_ms")


def metric_summary(runs: DataFrame) -> DataFrame:
    """Plain means, sample-weighted means and sums over the runs' metric envelopes."""
    names = (*MEANS, *WEIGHTED, *SUMS)
    rows = runs.select(F.explode(F.map_filter("metrics", lambda k, v: k.isin(*names) & v["value"].isNotNull()))
                       .alias("metric", "m"))
    value, count = F.col("m.value"), F.col("m.sample_count")
    grouped = rows.groupBy("metric").agg(
        F.sum(value).alias("_sum"), F.count("*").alias("_n"),
        F.sum(value * count).alias("_weighted"), F.sum(count).alias("_weight"))
    every = runs.sparkSession.createDataFrame([(n,) for n in names], "metric string")
    name = F.col("metric")
    total = F.when(name.isin(*WEIGHTED), F.try_divide(F.col("_weighted"), F.col("_weight").cast("double"))) \
        .when(name.isin(*SUMS), F.col("_sum")).otherwise(F.col("_sum") / F.col("_n"))
    samples = F.coalesce(F.when(name.isin(*WEIGHTED), F.col("_weight")).otherwise(F.col("_n")), F.lit(0))
    unit = F.when(name == "browser_wait_ms", "ms").when(name.isin(*SUMS), "").otherwise("ratio")
    return every.join(F.broadcast(grouped), "metric", "left").select(
        "metric", total.alias("value"), unit.alias("unit"), samples.alias("sample_count"),
        F.when(total.isNull(), "unavailable").otherwise("measured").alias("source"),
        F.when(total.isNull(), "no eligible samples").alias("reason"))


def node_summary(nodes: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Mean and p95 runtime per node, skipped runs left out."""
    timed = nodes.filter(F.col("runtime_ms").isNotNull() & (F.col("status") != "skipped"))
    tail = percentiles(timed, ["node"], "runtime_ms", [0.95], key_rows, mean="average_runtime_ms")
    return tail.select(
        "node", "average_runtime_ms", F.get("percentiles", F.lit(0)).alias("p95_runtime_ms"),
        F.col("n").alias("sample_count"))


def by_workflow(runs: DataFrame) -> DataFrame:
    return runs.groupBy("workflow_type").count().withColumnRenamed("count", "runs")


# -- event-time windows ----------------------------------------------------------------------

def windowed(events: DataFrame, width: str, slide: str | None = None, value: str = "value") -> DataFrame:
    """Counts, failures and mean value per event-time window; tumbling unless ``slide`` is given."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(span.alias("w")).agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(value).alias("total_value")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "failed",
        "total_value")


def sliding_from_tumbling(events: DataFrame, hours: int = 24, value: str = "value") -> DataFrame:
    """Sliding last-``hours`` windows every hour, built from hourly totals.

    Each event is counted once per hour bucket; only the bucket totals are repeated per window.
    """
    hourly = windowed(events, "1 hour", value=value)
    starts = F.sequence(F.col("window_start") - F.make_interval(hours=F.lit(hours - 1)),
                        F.col("window_start"), F.expr("interval 1 hour"))
    return hourly.select(F.explode(starts).alias("s"), "events", "failed", "total_value").groupBy("s").agg(
        F.sum("events").alias("events"), F.sum("failed").alias("failed"),
        F.sum("total_value").alias("total_value")).select(
        F.col("s").alias("window_start"), (F.col("s") + F.make_interval(hours=F.lit(hours))).alias("window_end"),
        "events", "failed", "total_value")


def activity_sessions(events: DataFrame, gap_seconds: int = 1800, key: str = "task_id",
                      value: str = "value") -> DataFrame:
    """Bursts of activity per task, split where the pause is longer than the gap.

    Events are first combined into buckets no wider than the gap: two events of one bucket are
    never split. The window then sees at most one row per task and gap-length of time, whatever
    share of the log a task owns.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = events.schema["ts"].dataType
    gap = gap_seconds * 1_000_000
    buckets = events.groupBy(key, F.floor(micros / F.lit(gap)).alias("_b")).agg(
        F.min(micros).alias("_from"), F.max(micros).alias("_to"), F.count("*").alias("_n"),
        F.sum(value).alias("_v"))
    order = Window.partitionBy(key).orderBy("_b")
    starts = (F.col("_from") - F.lag("_to").over(order) > gap) | F.lag("_to").over(order).isNull()
    marked = buckets.withColumn("_new", starts.cast("int")) \
        .withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session_no").agg(
        F.timestamp_micros(F.min("_from")).cast(kind).alias("session_start"),
        F.timestamp_micros(F.max("_to")).cast(kind).alias("last_event"),
        F.sum("_n").alias("events"), F.sum("_v").alias("total_value"))

