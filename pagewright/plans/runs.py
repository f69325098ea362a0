"""Telemetry, A/B iterations, review and sinks over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators import iterations, review, rolling, skew, telemetry
from ..operators.evaluate import ENVELOPE
from ..sources.sinks import append, drop_heavy, latest_per_key, read_upserted
from ..sources.tables import stored, table
from ..streaming import events as stream
from .extraction import verified as verified_pages
from .pages import big
from .registry import query

# A task per user; the event type stands for the state the task reports.
_STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END"


def log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id", "user_id AS task_id", "event_type", f"{_STATE} AS status", "ts", "value",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")


_LOG = f"""log AS (SELECT event_id, user_id AS task_id, event_type, {_STATE} AS status, ts, value,
    CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events),
  seq AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS sequence FROM log)"""


@query(f"WITH {_LOG} SELECT event_id, task_id, sequence FROM seq")
def event_sequence(spark, folder):
    return telemetry.assign_sequence(log(spark, folder)).select("event_id", "task_id", "sequence")


@query(f"WITH {_LOG} SELECT event_id, task_id, sequence FROM seq")
def event_sequence_hot_tasks(spark, folder):
    """The same numbering on the path taken when tasks are too large for one partition."""
    return telemetry.assign_sequence(log(spark, folder), key_rows=20).select("event_id", "task_id", "sequence")


@query(f"WITH {_LOG} SELECT event_id, task_id, sequence FROM seq")
def appended_sequence(spark, folder):
    """The log in two appends: the second goes on with the numbers that the first has stored."""
    rows = log(spark, folder)
    middle = rows.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2))
                      .cast(rows.schema["ts"].dataType)).scalar()
    place = f"{_place(spark)}/log"
    append(telemetry.assign_sequence(rows.filter(F.col("ts") < middle)), place)
    stored_log = spark.read.parquet(place)
    append(telemetry.continue_sequence(stored_log, rows.filter(F.col("ts") >= middle)), place)
    return spark.read.schema(stored_log.schema).parquet(place).select("event_id", "task_id", "sequence")


_KEYLESS = f"""{_LOG}, nul AS (SELECT event_id, ts, CASE WHEN task_id%3=0 THEN NULL ELSE task_id END AS task_id, value FROM log)"""


@query(f"""WITH {_KEYLESS} SELECT event_id, task_id, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS sequence FROM nul""")
def event_sequence_missing_tasks(spark, folder):
    """Events of no known task are numbered too, whatever their share; on the path for large tasks."""
    rows = log(spark, folder).withColumn("task_id", F.when(F.col("task_id") % 3 != 0, F.col("task_id")))
    return telemetry.assign_sequence(rows, key_rows=20).select("event_id", "task_id", "sequence")


@query(f"""WITH {_LOG} SELECT event_id, sequence, event_type FROM seq WHERE task_id=8 AND sequence>5
  ORDER BY sequence LIMIT 200""")
def event_cursor_page(spark, folder):
    numbered = telemetry.assign_sequence(stored(log(spark, folder), "task_id", 8))
    return telemetry.page_after(numbered, 8, 5).select("event_id", "sequence", "event_type")


@query(f"""WITH {_LOG} SELECT coalesce(max(sequence),5) AS next_cursor FROM (SELECT sequence FROM seq WHERE task_id=8 AND sequence>5
  ORDER BY sequence LIMIT 200)""")
def event_next_cursor(spark, folder):
    numbered = telemetry.assign_sequence(stored(log(spark, folder), "task_id", 8))
    return telemetry.next_cursor(telemetry.page_after(numbered, 8, 5), 5)


@query(f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY status IN ('completed','failed') DESC,
    sequence DESC) AS n, count(*) OVER (PARTITION BY task_id) AS event_count FROM seq)
  SELECT task_id, status, sequence, value, event_count FROM r WHERE n=1""")
def latest_state(spark, folder):
    return telemetry.latest_state(telemetry.assign_sequence(log(spark, folder)), "value")


def _runs(spark, folder) -> DataFrame:
    """Every event as a run of its own: started after a wait of k ms, ran ``value`` ms."""
    return log(spark, folder).select(
        F.col("event_id").alias("task_id"), F.col("event_type").alias("workflow_type"),
        F.when(F.col("k") % 10 == 0, "queued").otherwise(F.col("status")).alias("status"),
        F.col("ts").alias("created_at"), (F.col("ts") + F.expr("make_dt_interval(0,0,0,k/1000.0)")).alias("start_time"),
        F.col("value").alias("runtime_ms"), F.when(F.col("k") % 5 == 0, F.col("task_id")).alias("parent_task_id"), "k",
    ).withColumn("queue_wait_ms", telemetry.queue_wait_ms(F.col("created_at"), F.col("start_time")))


_RUNS = f"""{_LOG}, runs AS (SELECT event_id AS task_id, event_type AS workflow_type, CASE WHEN k%10=0 THEN 'queued' ELSE status END AS status,
    ts AS created_at, value AS runtime_ms, CASE WHEN k%5=0 THEN task_id END AS parent_task_id, k::DOUBLE AS queue_wait_ms, k FROM log)"""
_SUMMARY = """SELECT count(*) AS total, count(*) FILTER (status='queued') AS queued, count(*) FILTER (status='running') AS running,
    count(*) FILTER (status='completed') AS completed, count(*) FILTER (status='failed') AS failed,
    count(*) FILTER (status IN ('completed','failed')) AS terminal, count(*) FILTER (status IN ('completed','failed')) AS runtime_samples,
    round(avg(runtime_ms) FILTER (status IN ('completed','failed')),6) AS average_runtime_ms,
    round(quantile_cont(runtime_ms,0.5) FILTER (status IN ('completed','failed')),6) AS p50_runtime_ms,
    round(quantile_cont(runtime_ms,0.95) FILTER (status IN ('completed','failed')),6) AS p95_runtime_ms,
    round(quantile_cont(runtime_ms,0.99) FILTER (status IN ('completed','failed')),6) AS p99_runtime_ms,
    round(count(*) FILTER (status='failed')/count(*) FILTER (status IN ('completed','failed')),6) AS failure_rate,
    round(avg(queue_wait_ms),6) AS average_queue_wait_ms"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


@query(f"WITH {_RUNS} {_SUMMARY} FROM runs")
def run_summary(spark, folder):
    return _rounded(telemetry.summarize_runs(_runs(spark, folder)))


@query(f"WITH {_RUNS} {_SUMMARY} FROM runs")
def run_summary_large(spark, folder):
    """Exact percentiles on the path taken for groups too large for one task."""
    return _rounded(telemetry.summarize_runs(_runs(spark, folder), key_rows=300))


@query(f"""WITH {_RUNS} {_SUMMARY} FROM runs WHERE parent_task_id IS NULL
  AND created_at>=(SELECT max(ts) FROM events)-INTERVAL 48 HOUR""")
def recent_run_summary(spark, folder):
    """The last 48 hours of root runs; 'now' is the newest event."""
    runs = _runs(spark, folder)
    now = runs.agg(F.max("created_at")).scalar()
    return _rounded(telemetry.summarize_runs(telemetry.recent_roots(runs, now, 48)))


@query(f"WITH {_RUNS} SELECT workflow_type, count(*) AS runs FROM runs GROUP BY 1")
def runs_by_workflow(spark, folder):
    return telemetry.by_workflow(_runs(spark, folder))


def _measured(spark, folder) -> DataFrame:
    """Runs with metric envelopes derived from k and value."""
    k = F.col("k")

    def m(value, count):
        return telemetry.envelope(value, count)

    score = (k % 10) / 10.0
    return _runs(spark, folder).withColumn("metrics", F.create_map(
        F.lit("verification_score"), m(score, F.lit(1)),
        F.lit("field_completion_rate"), m(F.when(k % 4 != 0, (k % 7) / 7.0), k % 5),
        F.lit("collection_success_rate"), m((k % 3) / 2.0, k % 4),
        F.lit("evidence_coverage"), m((k % 6) / 5.0, F.lit(1)),
        F.lit("required_field_missing_rate"), m((k % 2) / 4.0, F.lit(1)),
        F.lit("model_call_count"), m((k % 8).cast("double"), F.lit(1)),
        F.lit("browser_wait_ms"), m(F.when(k % 9 == 0, F.col("runtime_ms")), F.lit(1))))


@query(f"""WITH {_RUNS}, m AS (SELECT 'verification_score' AS metric, avg((k%10)/10.0) AS value, count(*) AS n FROM runs
  UNION ALL SELECT 'evidence_coverage', avg((k%6)/5.0), count(*) FROM runs
  UNION ALL SELECT 'field_completion_rate', sum((k%7)/7.0*(k%5))/sum(k%5), sum(k%5) FROM runs WHERE k%4<>0
  UNION ALL SELECT 'collection_success_rate', sum((k%3)/2.0*(k%4))/sum(k%4), sum(k%4) FROM runs
  UNION ALL SELECT 'required_field_missing_rate', avg((k%2)/4.0), count(*) FROM runs
  UNION ALL SELECT 'model_call_count', sum(k%8), count(*) FROM runs
  UNION ALL SELECT 'browser_wait_ms', sum(runtime_ms), count(*) FROM runs WHERE k%9=0
  UNION ALL SELECT unnest(['verification_passed','program_reuse','page_intent_confidence','body_visible_text_coverage',
    'body_block_coverage','body_continuity_score','body_noise_ratio','browser_launch_success_rate','optional_field_missing_rate',
    'repair_supported_rate','collection_attempt_count','fallback_attempt_count','access_limited_count','schema_failure_count',
    'token_usage_missing_calls','selector_attempt_count','selector_ambiguity_count','selector_error_count',
    'program_rule_rejection_count','body_candidate_count','body_merged_candidate_count','program_reuse_reason_count']), NULL, 0)
  SELECT metric, round(value,6) AS value, CAST(n AS BIGINT) AS sample_count, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'measured' END AS source,
    CASE WHEN value IS NULL THEN 'no eligible samples' END AS reason FROM m""")
def weighted_ratio_summary(spark, folder):
    return _rounded(telemetry.metric_summary(_measured(spark, folder))).select(
        "metric", "value", "sample_count", "source", "reason")


_NODES = f"""{_LOG}, nev AS (SELECT task_id, event_type AS node, event_id%2=0 AS started, ts, value AS runtime_ms, event_id,
    CASE WHEN k%4=0 THEN 'skipped' WHEN k%7=0 THEN 'failed' ELSE 'success' END AS status FROM log),
  node AS (SELECT task_id, node, min(ts) FILTER (started) AS start_time, min(ts) FILTER (NOT started) AS end_time,
    coalesce(arg_min(status,event_id) FILTER (NOT started),'running') AS status,
    arg_min(runtime_ms,event_id) FILTER (NOT started) AS runtime_ms FROM nev GROUP BY 1,2),
  task AS (SELECT task_id, CASE WHEN bool_or(status='failed') THEN 'failed' WHEN bool_or(status='completed') THEN 'completed'
    ELSE 'running' END AS status FROM log GROUP BY 1)"""


def _node_events(spark, folder) -> DataFrame:
    k = F.col("k")
    return log(spark, folder).select(
        "task_id", F.col("event_type").alias("node"),
        F.when(F.col("event_id") % 2 == 0, "node_started").otherwise("node_finished").alias("event_type"), "ts",
        F.col("event_id").alias("sequence"), F.col("value").alias("runtime_ms"),
        F.when(k % 4 == 0, "skipped").when(k % 7 == 0, "failed").otherwise("success").alias("status"))


def _tasks(spark, folder) -> DataFrame:
    s = F.col("status")
    return log(spark, folder).groupBy("task_id").agg(
        F.when(F.max(s == "failed"), "failed").when(F.max(s == "completed"), "completed").otherwise("running").alias("status"))


@query(f"WITH {_NODES} SELECT * FROM node")
def node_lifecycle(spark, folder):
    return telemetry.node_runs(_node_events(spark, folder))


@query(f"""WITH {_NODES} SELECT task_id, 5 AS total_nodes, count(*) FILTER (status IN ('success','skipped')) AS completed_nodes,
  round(100.0*count(*) FILTER (status IN ('success','skipped'))/5,1) AS progress FROM node GROUP BY 1""")
def task_progress(spark, folder):
    nodes = telemetry.node_runs(_node_events(spark, folder))
    totals = _tasks(spark, folder).select("task_id", F.lit(5).cast("bigint").alias("total_nodes"))
    return telemetry.task_progress(nodes, totals)


@query(f"""WITH {_NODES} SELECT t.task_id, n.node, 'skipped' AS status, CASE t.status WHEN 'failed' THEN 'upstream failure' ELSE 'not required' END
  AS output_summary FROM task t CROSS JOIN (VALUES ('click'),('view'),('export')) n(node) WHERE t.status<>'running'
  AND NOT EXISTS (SELECT 1 FROM node x WHERE x.task_id=t.task_id AND x.node=n.node AND end_time IS NOT NULL)""")
def closed_nodes(spark, folder):
    tasks = _tasks(spark, folder)
    expected = tasks.select("task_id", F.explode(F.array(*[F.lit(n) for n in ("click", "view", "export")])).alias("node"))
    return telemetry.close_nodes(expected, telemetry.node_runs(_node_events(spark, folder)), tasks)


@query(f"""WITH {_NODES} SELECT node, round(avg(runtime_ms),6) AS average_runtime_ms, round(quantile_cont(runtime_ms,0.95),6) AS p95_runtime_ms,
  count(*) AS sample_count FROM node WHERE runtime_ms IS NOT NULL AND status<>'skipped' GROUP BY 1""")
def node_runtime_p95(spark, folder):
    return _rounded(telemetry.node_summary(telemetry.node_runs(_node_events(spark, folder))))


@query(f"""WITH {_NODES} SELECT node, round(avg(runtime_ms),6) AS average_runtime_ms, round(quantile_cont(runtime_ms,0.95),6) AS p95_runtime_ms,
  count(*) AS sample_count FROM (SELECT node, runtime_ms FROM nev WHERE status<>'skipped') GROUP BY 1""")
def node_runtime_p95_large(spark, folder):
    """Per-node percentiles over every event, on the path for very large groups."""
    return _rounded(telemetry.node_summary(_node_events(spark, folder), key_rows=200))


@query(f"""WITH {_LOG}, l AS (SELECT task_id+1000*(event_id//500) AS task_id, status FROM log)
  SELECT task_id, 'failed' AS status, 'backend restart interrupted task' AS error FROM l GROUP BY 1
  HAVING NOT bool_or(status IN ('completed','failed'))""")
def interrupted_tasks(spark, folder):
    rows = log(spark, folder).withColumn("task_id", F.expr("task_id + 1000 * (event_id div 500)"))
    return telemetry.interrupted(rows).select("task_id", "status", F.col("errors")[0].alias("error"))


@query(f"""WITH {_RUNS}, q AS (SELECT event_id AS request_id, event_id+1 AS original_task_id, ts FROM events),
  j AS (SELECT q.*, r.task_id AS found, r.status, r.k, r.workflow_type FROM q LEFT JOIN runs r ON r.task_id=original_task_id),
  e AS (SELECT *, CASE WHEN found IS NULL THEN 'run not found' WHEN status<>'failed' THEN 'only failed runs can be retried'
    WHEN k%3=0 THEN 'run input was not retained; retry is unavailable' END AS error FROM j)
  SELECT request_id, error, CASE WHEN error IS NULL THEN workflow_type||'-'||(k%4) END AS correlation_id,
    CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL, workflow_type, k%4 ORDER BY ts, request_id) END AS attempt FROM e""")
def retry_receipts(spark, folder):
    runs = _runs(spark, folder).withColumn(
        "correlation_id", F.concat("workflow_type", F.lit("-"), (F.col("k") % 4).cast("string"))) \
        .withColumn("input_retained", F.col("k") % 3 != 0)
    asked = table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"), (F.col("event_id") + 1).alias("original_task_id"),
        F.col("ts").alias("requested_at"))
    return telemetry.retry_receipts(runs, asked).select("request_id", "error", F.when(
        F.col("error").isNull(), F.col("correlation_id")).alias("correlation_id"), "attempt")


@query(f"""WITH {_LOG} SELECT date_trunc('hour',ts) AS window_start, date_trunc('hour',ts)+INTERVAL 1 HOUR AS window_end,
  count(*) AS events, count(*) FILTER (status='failed') AS failed, round(sum(value),4) AS total_value FROM log GROUP BY 1,2""")
def hourly_windows(spark, folder):
    rows = telemetry.windowed(log(spark, folder), "1 hour")
    return rows.withColumn("total_value", F.round("total_value", 4))


@query(f"""WITH {_LOG}, h AS (SELECT date_trunc('hour',ts) AS h, status, value FROM log)
  SELECT s AS window_start, s+INTERVAL 24 HOUR AS window_end, count(*) AS events, count(*) FILTER (status='failed') AS failed,
    round(sum(value),4) AS total_value FROM (SELECT h-to_hours(CAST(i AS INT)) AS s, status, value FROM h, range(24) t(i)) GROUP BY 1,2""")
def sliding_day_windows(spark, folder):
    rows = telemetry.sliding_from_tumbling(log(spark, folder))
    return rows.withColumn("total_value", F.round("total_value", 4))


def _percentile_sql(hours: int) -> str:
    return f"""WITH {_LOG}, h AS (SELECT date_trunc('hour',ts) AS h, value FROM log WHERE value IS NOT NULL)
  SELECT h-to_hours(CAST(i AS INT)) AS window_start, count(*) AS events, round(quantile_cont(value,0.5),6) AS p50,
    round(quantile_cont(value,0.95),6) AS p95, round(quantile_cont(value,0.99),6) AS p99 FROM h, range({hours}) t(i) GROUP BY 1"""


def _three(rows: DataFrame) -> DataFrame:
    return rows.select("window_start", F.col("n").alias("events"), *[
        F.round(F.get("percentiles", F.lit(i)), 6).alias(f"p{p}") for i, p in enumerate((50, 95, 99))])


@query(_percentile_sql(1))
def hourly_percentiles(spark, folder):
    """Exact percentiles of every hour, found between the bounds that its sketch gives."""
    return _three(rolling.rolling_percentiles(log(spark, folder), hours=1))


@query(_percentile_sql(24))
def rolling_day_percentiles(spark, folder):
    """The same for 24 hours from every hour on, from the merged sketches of the hours."""
    return _three(rolling.rolling_percentiles(log(spark, folder)))


@query(f"""WITH {_LOG}, g AS (SELECT *, CASE WHEN ts-lag(ts) OVER w<=INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM log
    WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS session_no FROM g)
  SELECT task_id, session_no, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events, round(sum(value),4) AS total_value
  FROM s GROUP BY 1,2""")
def user_sessions(spark, folder):
    rows = telemetry.activity_sessions(log(spark, folder), 1800)
    return rows.withColumn("total_value", F.round("total_value", 4))


# -- streams ---------------------------------------------------------------------------------

def _place(spark: SparkSession) -> str:
    """A fresh folder for a stream's output and state, shared by all executors."""
    return session.shared_folder(spark, "stream")


def _stream(spark, folder) -> DataFrame:
    raw = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    source = spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(folder)
    return source.selectExpr("event_id", "user_id AS task_id", "event_id AS sequence", "event_type", f"{_STATE} AS status",
                             "ts", "value")


def _drain(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over what is there now and read back what it wrote."""
    place = _place(spark)
    run = df.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out") \
        .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out")


@query("SELECT event_id, user_id AS task_id, event_type FROM events")
def stream_deduplicated(spark, folder):
    """The log read twice in one stream: every event id comes out once."""
    twice = _stream(spark, folder).unionByName(_stream(spark, folder))
    return _drain(stream.deduplicated(twice, "40 days"), spark).select("event_id", "task_id", "event_type")


@query(f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY status IN ('completed','failed') DESC,
    event_id DESC) AS n FROM log) SELECT task_id, status, event_id AS sequence FROM r WHERE n=1""")
def stream_latest_state(spark, folder):
    place = _place(spark)
    stream.write_latest(_stream(spark, folder), f"{place}/latest", f"{place}/state").awaitTermination()
    return read_upserted(spark, f"{place}/latest").select("task_id", "status", "sequence")


@query(f"""WITH {_LOG} SELECT date_trunc('hour',ts) AS window_start, count(*) AS events, count(*) FILTER (status='failed') AS failed,
  round(sum(value),4) AS total_value FROM log GROUP BY 1 HAVING date_trunc('hour',min(ts))+INTERVAL 1 HOUR
  <=(SELECT max(ts) FROM events)-INTERVAL 10 MINUTE""")
def stream_hourly_windows(spark, folder):
    """Windows the watermark has closed; the newest ones stay open."""
    rows = _drain(stream.hourly(_stream(spark, folder)), spark)
    return rows.select("window_start", "events", "failed", F.round("total_value", 4).alias("total_value"))


@query(f"""WITH {_LOG}, g AS (SELECT *, CASE WHEN ts-lag(ts) OVER w<=INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM log
    WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS n FROM g)
  SELECT task_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY task_id, n
  HAVING max(ts)+INTERVAL 30 MINUTE<=(SELECT max(ts) FROM events)-INTERVAL 10 MINUTE""")
def stream_sessions(spark, folder):
    return _drain(stream.sessions(_stream(spark, folder)), spark).select("task_id", "session_start", "events")


# -- run metrics -----------------------------------------------------------------------------

@query(f"""WITH {_LOG}, c AS (SELECT task_id, count(*) FILTER (event_type='click') AS attempts,
    count(*) FILTER (event_type='click' AND value<20) AS ok, count(*) FILTER (event_type='click' AND k%2=0) AS fb,
    count(*) FILTER (event_type='click' AND value>30) AS lim, count(*) FILTER (event_type='view') AS sel,
    count(*) FILTER (event_type='view' AND k%3=0) AS amb, count(*) FILTER (event_type='error') AS rej,
    count(*) FILTER (event_type='purchase') AS rep, count(*) FILTER (event_type='purchase' AND k%2=0) AS repok,
    count(*) FILTER (event_type='signup') AS calls, count(*) FILTER (event_type='signup' AND k%5=0) AS lost,
    coalesce(sum(k) FILTER (event_type='signup' AND k%5<>0),0) AS tokens FROM log GROUP BY 1),
  p AS (SELECT page_id AS task_id, c.* EXCLUDE (task_id) FROM pages LEFT JOIN c ON c.task_id=page_id),
  m AS (SELECT task_id, 'collection_attempt_count' AS metric, coalesce(attempts,0)::DOUBLE AS value, 1 AS n FROM p
    UNION ALL SELECT task_id, 'collection_success_rate', ok/nullif(attempts,0), coalesce(attempts,0) FROM p
    UNION ALL SELECT task_id, 'fallback_attempt_count', coalesce(fb,0), 1 FROM p
    UNION ALL SELECT task_id, 'access_limited_count', coalesce(lim,0), 1 FROM p
    UNION ALL SELECT task_id, 'selector_attempt_count', coalesce(sel,0), 1 FROM p
    UNION ALL SELECT task_id, 'selector_ambiguity_count', coalesce(amb,0), 1 FROM p
    UNION ALL SELECT task_id, 'program_rule_rejection_count', coalesce(rej,0), 1 FROM p
    UNION ALL SELECT task_id, 'repair_supported_rate', repok/nullif(rep,0), coalesce(rep,0) FROM p
    UNION ALL SELECT task_id, 'model_call_count', coalesce(calls,0), coalesce(calls,0) FROM p
    UNION ALL SELECT task_id, 'token_usage_missing_calls', coalesce(lost,0), coalesce(calls,0) FROM p
    UNION ALL SELECT task_id, 'actual_input_tokens', CASE WHEN coalesce(lost,0)=0 THEN coalesce(tokens,0) END, coalesce(calls,0) FROM p
    UNION ALL SELECT task_id, 'partial_actual_input_tokens', coalesce(tokens,0), coalesce(calls,0) FROM p
    UNION ALL SELECT task_id, 'schema_field_count', 5, 1 FROM p
    UNION ALL SELECT task_id, 'page_intent_confidence', NULL, 0 FROM p)
  SELECT task_id, metric, round(value,6) AS value, CAST(n AS BIGINT) AS sample_count,
    CASE WHEN value IS NULL THEN 'unavailable' ELSE 'measured' END AS source FROM m""")
def run_metrics(spark, folder):
    """One run per page: its verified extraction joined with the events of the same number."""
    shown = ("collection_attempt_count", "collection_success_rate", "fallback_attempt_count", "access_limited_count",
             "selector_attempt_count", "selector_ambiguity_count", "program_rule_rejection_count", "repair_supported_rate",
             "model_call_count", "token_usage_missing_calls", "actual_input_tokens", "partial_actual_input_tokens",
             "schema_field_count", "page_intent_confidence")
    rows = _metered(spark, folder).select("task_id", F.explode("metrics").alias("metric", "m"))
    return _rounded(rows.filter(F.col("metric").isin(*shown)).select(
        "task_id", "metric", F.col("m.value").alias("value"), F.col("m.sample_count").alias("sample_count"),
        F.col("m.source").alias("source")))


def _metered(spark, folder) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in (
        ("click", "collection_attempt"), ("view", "selector_execution"), ("error", "program_rule_rejected"),
        ("purchase", "field_repair"), ("signup", "model_call")) for x in p])
    k, value = F.col("k"), F.col("value")

    def flag(test):
        return F.when(test, "true").otherwise("false")

    details = F.create_map(
        F.lit("result"), F.when(F.col("event_type") == "view", F.when(k % 3 == 0, "ambiguous_matches").otherwise("success"))
        .when(value < 20, "success").otherwise("failed"),
        F.lit("classification"), F.when(value > 30, "access_limited").otherwise("usable_content"),
        F.lit("fallback_attempted"), flag(k % 2 == 0), F.lit("verified"), flag(k % 2 == 0),
        F.lit("http_attempted"), F.lit("true"), F.lit("actual_input_tokens"), F.when(k % 5 != 0, k.cast("string")),
        F.lit("actual_output_tokens"), F.lit("1"))
    events = log(spark, folder).select(
        "task_id", F.element_at(kind, F.col("event_type")).alias("event_type"), F.lit(None).cast("string").alias("node"),
        "status", "value", details.alias("details"))
    nothing = F.lit(None)
    runs = verified_pages(spark, folder).select(
        F.col("page_id").alias("task_id"), "fields", "results", "report", "issues",
        F.sha2("url", 256).alias("page_hash"), nothing.cast("struct<intent:string,confidence:double>").alias("intent"),
        nothing.cast("struct<visible_text_coverage:double,block_coverage:double,continuity_score:double,"
                     "noise_ratio:double,candidate_count:int,merged_candidate_count:int>").alias("body"),
        nothing.cast("struct<page_intent:string>").alias("structure"), F.array(F.lit(1)).alias("rules"),
        F.lit(False).alias("program_reused"), nothing.cast("array<string>").alias("program_reuse_reasons"),
        nothing.cast("string").alias("program_reuse_decision"), F.lit(12.0).alias("elapsed_ms"),
        F.lit(3.0).alias("queue_wait_ms"))
    return telemetry.run_metrics(runs, events)


@query("""SELECT page_id AS task_id, sha256(url) AS page_hash, 'extraction' AS workflow_type, 'create' AS program_spec_mode,
  false AS enable_field_repair, 'not_requested' AS program_reuse_decision, '2' AS evaluator_version FROM pages""")
def run_fingerprints(spark, folder):
    return _metered(spark, folder).select(
        "task_id", *[f"fingerprint.{n}" for n in ("page_hash", "workflow_type", "program_spec_mode", "enable_field_repair",
                                                  "program_reuse_decision", "evaluator_version")])


# -- A/B iterations --------------------------------------------------------------------------

def _ab_runs(spark, folder) -> DataFrame:
    k = F.col("k")
    text = {
        "page_hash": F.when(k % 3 == 0, "h1").when(k % 31 == 1, None).otherwise("h0"), "schema_signature": F.lit("s"),
        "model": F.lit("m"), "model_endpoint_hash": F.lit("e"), "program_spec_mode": F.lit("create"),
        "evaluator_version": F.lit("2")}
    fp = F.struct(*[v.cast("string").alias(n) for n, v in text.items()], F.lit(False).alias("enable_field_repair"),
                  F.lit(False).alias("reuse_verified_program"))

    def m(value, source=None):
        return F.struct(value.cast("double").alias("value"), (F.lit("measured") if source is None else source).alias("source"),
                        F.lit("").alias("unit"), F.lit(1).cast("bigint").alias("sample_count"),
                        F.lit(None).cast("string").alias("reason")).cast(ENVELOPE)

    return _runs(spark, folder).select(
        "task_id", F.when(F.col("status") == "running", "completed").otherwise(F.col("status")).alias("status"),
        F.when(k % 29 == 0, "benchmark").otherwise("extraction").alias("workflow_type"), "runtime_ms",
        fp.alias("fingerprint"), F.create_map(
            F.lit("verification_score"), m((k % 10) / 10.0),
            F.lit("field_completion_rate"), m((k % 5) / 4.0, F.when(k % 23 == 0, "estimated").otherwise("measured")),
            F.lit("evidence_coverage"), m((k % 4) / 3.0), F.lit("required_field_missing_rate"), m((k % 2) / 2.0),
            F.lit("average_confidence"), m(F.when(k % 6 != 0, (k % 8) / 8.0))).alias("metrics"),
        F.when(k % 37 != 0, F.lit("2")).alias("metrics_version"))


def _ab(spark, folder) -> DataFrame:
    e = table(spark, folder, "events")
    requests = e.select(
        F.col("event_id").alias("iteration_id"), F.col("event_type").alias("experiment_id"),
        F.col("event_id").alias("baseline_run_id"),
        F.when(F.col("event_id") % 50 == 0, F.col("event_id")).otherwise(F.col("event_id") + 1).alias("candidate_run_id"),
        F.when(F.col("event_id") % 9 == 0, F.col("event_id") - 1).alias("parent_iteration_id"))
    known = e.select(F.col("event_id").alias("iteration_id"), F.col("event_type").alias("experiment_id"))
    return iterations.evaluate_iterations(requests, _ab_runs(spark, folder), known)


_AB = f"""{_RUNS}, r AS (SELECT task_id, CASE status WHEN 'running' THEN 'completed' ELSE status END AS status,
    CASE WHEN k%29=0 THEN 'benchmark' ELSE 'extraction' END AS wf, runtime_ms AS rt, k,
    CASE WHEN k%3=0 THEN 'h1' WHEN k%31=1 THEN NULL ELSE 'h0' END AS hash, (k%10)/10.0::DOUBLE AS vs, (k%5)/4.0::DOUBLE AS fc,
    (k%4)/3.0::DOUBLE AS ec, (k%2)/2.0::DOUBLE AS mr, CASE WHEN k%6<>0 THEN (k%8)/8.0::DOUBLE END AS ac, k%37<>0 AS mv, k%23=0 AS est FROM runs),
  q AS (SELECT event_id AS iteration_id, event_type AS experiment_id, event_id AS b, CASE WHEN event_id%50=0 THEN event_id ELSE event_id+1 END AS c,
    CASE WHEN event_id%9=0 THEN event_id-1 END AS parent FROM events),
  j AS (SELECT q.*, x.status AS bs, y.status AS cs, p.event_type AS pe, x.k AS bk, y.k AS ck,
      list_filter([CASE WHEN x.hash IS DISTINCT FROM y.hash THEN 'page_hash' END, CASE WHEN x.wf<>'extraction' OR y.wf<>'extraction' THEN 'workflow_type' END,
        CASE WHEN x.hash IS NULL OR y.hash IS NULL THEN 'missing_page_hash' END, CASE WHEN q.b=q.c THEN 'identical_run_ids' END,
        CASE WHEN NOT x.mv OR NOT y.mv THEN 'missing_metrics_version' END], lambda z: z IS NOT NULL) AS apart,
      list_filter([CASE WHEN x.est THEN 'baseline.field_completion_rate' END, CASE WHEN y.est THEN 'candidate.field_completion_rate' END],
        lambda z: z IS NOT NULL) AS un,
      list_filter([CASE WHEN x.vs-y.vs>1e-9 THEN 'verification_score' END, CASE WHEN x.fc-y.fc>1e-9 THEN 'field_completion_rate' END,
        CASE WHEN x.ec-y.ec>1e-9 THEN 'evidence_coverage' END, CASE WHEN y.mr-x.mr>1e-9 THEN 'required_field_missing_rate' END],
        lambda z: z IS NOT NULL) AS worse,
      0.5*(y.vs-x.vs)+0.3*(y.fc-x.fc)+0.2*(y.ec-x.ec) AS gain, (y.rt-x.rt)/nullif(x.rt,0) AS slow, coalesce(x.rt,0)=0 OR y.rt IS NULL AS timeless, y.ac-x.ac AS dac
    FROM q LEFT JOIN r x ON x.task_id=b LEFT JOIN r y ON y.task_id=c LEFT JOIN events p ON p.event_id=parent),
  e AS (SELECT *, CASE WHEN bs IS NULL THEN 'run not found: '||b WHEN bs<>'completed' THEN 'run '||b||' is not completed'
      WHEN cs IS NULL THEN 'run not found: '||c WHEN cs<>'completed' THEN 'run '||c||' is not completed'
      WHEN parent IS NOT NULL AND pe IS NULL THEN 'parent iteration not found'
      WHEN parent IS NOT NULL AND pe<>experiment_id THEN 'parent iteration belongs to a different experiment' END AS error FROM j),
  d AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN len(apart)>0 OR len(un)>0 OR timeless THEN 'blocked' WHEN len(worse)>0 OR gain+1e-9<0.01 OR slow>0.2 THEN 'rejected'
      ELSE 'accepted' END AS status FROM e)"""


@query(f"""WITH {_AB} SELECT iteration_id, error, status, CASE WHEN error IS NOT NULL THEN NULL
    WHEN len(apart)>0 THEN 'incomparable fingerprints: '||array_to_string(apart,', ')
    WHEN len(un)>0 THEN 'guardrail measurements unavailable: '||array_to_string(un,', ')
    WHEN timeless THEN 'quality or runtime metric unavailable'
    WHEN len(worse)>0 THEN 'quality guardrail regression: '||array_to_string(worse,', ')
    WHEN gain+1e-9<0.01 THEN 'quality improvement is below configured threshold'
    WHEN slow>0.2 THEN 'latency regression exceeds configured threshold'
    ELSE 'quality improvement meets threshold within latency guardrail' END AS decision_reason,
  CASE WHEN error IS NULL AND len(un)=0 THEN round(gain,6)+0.0 END AS quality_delta, CASE WHEN error IS NULL THEN round(slow,6) END AS latency_ratio,
  CASE WHEN error IS NULL THEN round(dac,6)+0.0 END AS confidence_delta FROM d""")
def ab_decisions(spark, folder):
    rows = _ab(spark, folder).select(
        "iteration_id", "error", "status", "decision_reason",
        F.col("quality_delta") + 0.0, "latency_ratio",
        F.try_element_at("metric_deltas", F.lit("average_confidence")).alias("confidence_delta"))
    rows = rows.withColumnRenamed(rows.columns[4], "quality_delta")
    return _rounded(rows).select("iteration_id", "error", "status", "decision_reason",
                                 (F.col("quality_delta") + 0.0).alias("quality_delta"), "latency_ratio",
                                 (F.col("confidence_delta") + 0.0).alias("confidence_delta"))


@query(f"""WITH {_AB}, k AS (SELECT iteration_id, status, iteration_id%4 AS w FROM d WHERE status IS NOT NULL)
  SELECT iteration_id, CASE WHEN w<>0 AND status IN ('accepted','rejected') THEN 'rolled_back' ELSE status END AS status,
    CASE WHEN w<>0 AND status IN ('accepted','rejected') THEN 'because '||iteration_id END AS rollback_reason,
    CASE WHEN w<>0 AND status='blocked' THEN 'only accepted or rejected iterations can be rolled back' END AS error FROM k""")
def rolled_back_iterations(spark, folder):
    decided = _ab(spark, folder).filter("status is not null").select("iteration_id", "status")
    e = table(spark, folder, "events").filter("event_id % 4 <> 0")
    first = e.select(F.col("event_id").alias("iteration_id"), F.col("ts").alias("rollback_at"),
                     F.concat(F.lit("because "), F.col("event_id").cast("string")).alias("rollback_reason"))
    again = first.withColumn("rollback_at", F.col("rollback_at") + F.expr("interval 1 hour")) \
        .withColumn("rollback_reason", F.lit("later"))
    return iterations.roll_back(decided, first.unionByName(again)).select(
        "iteration_id", "status", "rollback_reason", "error")


# -- review and sinks ------------------------------------------------------------------------

def _reviews(spark, folder) -> DataFrame:
    k = F.col("k")
    rows = log(spark, folder).select(
        "task_id", F.col("event_id").alias("review_id"), (k % 2 == 0).alias("mark_verified"),
        F.when(k % 7 != 0, F.array(F.lit("rule"))).alias("rules"), (F.col("task_id") % 10).alias("schema_signature"),
        F.lit("s").alias("schema_name"), F.when(k % 3 != 0, F.col("event_type")).alias("rule_name"),
        F.col("event_id").alias("reviewed_at"))
    runs = table(spark, folder, "pages").select(
        F.col("page_id").alias("task_id"), (F.col("page_id") % 2 == 0).alias("checked"),
        (F.col("page_id") % 3 == 0).alias("passed"),
        F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("sig"), F.col("page_id").cast("string"))).alias("structure"))
    return review.publish_gate(rows, runs)


_GATE = f"""{_LOG}, g AS (SELECT event_id AS review_id, task_id, k, event_type, CASE WHEN k%2=0 AND k%7=0
    THEN 'program_spec is required when mark_program_verified is true' WHEN k%2=0 AND task_id<(SELECT count(*) FROM pages) AND task_id%2=0
    AND task_id%3<>0 THEN 'quality check must pass before a rule can be verified' END AS problem FROM log)"""


@query(f"WITH {_GATE} SELECT review_id, problem FROM g")
def review_gate(spark, folder):
    return _reviews(spark, folder).select("review_id", "problem")


@query(f"""WITH {_GATE}, ok AS (SELECT task_id%10 AS s, review_id, CASE WHEN k%3<>0 THEN event_type ELSE 's' END AS rule_name,
    CASE WHEN task_id<(SELECT count(*) FROM pages) AND task_id%5<>0 THEN 'sig'||task_id END AS sig FROM g WHERE problem IS NULL AND k%2=0)
  SELECT s AS schema_signature, arg_max(rule_name, review_id) AS rule_name, coalesce(nullif(arg_max(coalesce(sig,''),review_id),''),
    arg_max(sig,review_id) FILTER (sig IS NOT NULL)) AS structure FROM ok GROUP BY 1""")
def promoted_programs(spark, folder):
    gated = _reviews(spark, folder)
    empty = gated.filter("1 = 0").select(
        "schema_signature", "schema_name", F.lit(True).alias("user_verified"), "rule_name", "rules", "structure",
        F.col("reviewed_at").alias("created_at"))
    return review.promote(gated, empty).select("schema_signature", "rule_name", "structure")


@query(f"""WITH {_LOG} SELECT task_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM log GROUP BY 1""")
def keyed_upsert(spark, folder):
    rows = log(spark, folder).select("task_id", "event_id", "event_type", F.col("ts").alias("written_at"),
                                     F.lit("<html>").alias("input_html"))
    old, new = rows.filter("event_type = 'view'"), rows.filter("event_type <> 'view'")
    return drop_heavy(latest_per_key(old, new, ["task_id"])).select("task_id", "event_id", "event_type")


@query(f"""WITH {_LOG} SELECT task_id, count(*) AS events, max(event_id) AS last FROM log WHERE task_id=17 GROUP BY 1""")
def stored_lookup(spark, folder):
    return stored(log(spark, folder), "task_id", 17).groupBy("task_id").agg(
        F.count("*").alias("events"), F.max("event_id").alias("last"))


@query(f"""WITH {_LOG}, t AS (SELECT task_id, count(*) AS n FROM log GROUP BY 1) SELECT event_id, n AS task_events FROM log JOIN t USING (task_id)""")
def skewed_lookup(spark, folder):
    """A lookup too large to broadcast: hot keys are salted, cold keys are not."""
    rows = log(spark, folder)
    side = rows.groupBy("task_id").agg(F.count("*").alias("task_events"))
    return skew.attach(rows, side, "task_id", rows=10, hot_rows=70, salts=4).select("event_id", big("task_events"))
