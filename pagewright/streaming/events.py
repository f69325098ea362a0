"""The event log as a stream: de-duplicated ingest, latest state per task, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import TERMINAL
from ..session import ship
from ..sources import snapshots

EVENT_SCHEMA = ("event_id bigint, task_id bigint, sequence bigint, event_type string, status string, "
                "ts timestamp, value double")


def read_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder; the offsets live in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once; state older than the lateness bound is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_states(events: DataFrame) -> DataFrame:
    """Running latest state per task (update mode). Terminal states win over later events.

    The state is one small aggregate per task; partial aggregates combine before the shuffle.
    """
    rank = F.struct(F.col("status").isin(*TERMINAL), F.col("sequence"))
    return events.groupBy("task_id").agg(
        F.max_by(F.struct("status", "sequence", "ts"), rank).alias("s"), F.count("*").alias("events")) \
        .select("task_id", "s.*", "events")


STATE = "terminal boolean, sequence bigint"
LATEST = "task_id bigint, status string, sequence bigint, ts timestamp"
_LOWEST = (False, -(1 << 63))


def _ranked(events: pd.DataFrame) -> pd.DataFrame:
    """The best event of every task of one batch: terminal states first, then by sequence."""
    ranked = events.assign(_t=events["status"].isin(TERMINAL), _s=events["sequence"].fillna(_LOWEST[1]))
    return ranked.sort_values(["_t", "_s"], kind="stable").drop_duplicates("task_id", keep="last").drop(columns=["_t", "_s"])


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _ranked(batch)


def _advance(expire_ms: int):
    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        out = None
        for frame in frames:
            row = _ranked(frame).iloc[-1:]
            sequence = row["sequence"].iloc[0]
            rank = (bool(row["status"].isin(TERMINAL).iloc[0]), _LOWEST[1] if pd.isna(sequence) else int(sequence))
            if best is None or rank > tuple(best):
                best, out = rank, row
        state.update(best)
        if best[0]:
            state.setTimeoutDuration(expire_ms)
        if out is not None:
            yield out
    return advance


def changed_states(events: DataFrame, expire_ms: int = 86_400_000) -> DataFrame:
    """The tasks whose latest state changed in a micro-batch, from state kept per task (update mode).

    Events are combined per Arrow batch before the shuffle, so a busy task sends few rows. The state is a
    flag and a number; a timer drops that of a finished task after ``expire_ms``. No event is late: one that
    comes after the timer meets an empty state, and the table it is written to still ranks it.
    """
    ship(events.sparkSession)
    few = events.select("task_id", "status", "sequence", "ts").mapInPandas(_combined, LATEST)
    return few.groupBy("task_id").applyInPandasWithState(
        _advance(expire_ms), LATEST, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


@contextmanager
def no_idle_batches(spark: SparkSession) -> Iterator[None]:
    """Streams started inside run batches for new data only: with timers they would otherwise run for ever.

    A stream keeps the settings it was started with; the session gets its own back.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_latest(events: DataFrame, path: str, checkpoint: str, expire_ms: int = 86_400_000) -> StreamingQuery:
    """Keep a keyed table of latest states up to date: a version per micro-batch, of its changed tasks only.

    The table remembers the last batch of this stream, so a replayed one changes nothing.
    """
    def merge(batch: DataFrame, number: int) -> None:
        ranked = batch.withColumn("written_at", F.struct(
            F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)).alias("terminal"), "sequence"))
        snapshots.upsert(ranked, path, ["task_id"], stream=checkpoint, batch=number)

    with no_idle_batches(events.sparkSession):
        return changed_states(events, expire_ms).writeStream.outputMode("update").foreachBatch(merge) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event-time windows, emitted once the watermark has passed them (append mode)."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(span.alias("w")).agg(
        F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("value").alias("total_value")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "failed",
                "total_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity bursts per task (append mode).

    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` combines a busy
    task's events before they are shuffled.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return events.withWatermark("ts", late).groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"), F.sum("value").alias("total_value")) \
        .select("task_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events",
                "total_value")
