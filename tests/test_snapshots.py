"""Keyed tables: readers during writes, dead writers, growth, replays; latest states from a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagewright.sources import sinks, snapshots
from pagewright.streaming import events as stream

FIELDS = "task_id int, value string, written_at int"


def rows(spark, *items):
    return spark.createDataFrame(list(items), FIELDS)


def content(spark, path, version=None):
    return sorted((r.task_id, r.value) for r in snapshots.read(spark, path, version).collect())


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert snapshots.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.upsert(rows(spark, (1, "a", 1), (2, "b", 1)), path, ["task_id"]) == 1
    before = snapshots.read(spark, path)
    seen = []
    publish = snapshots._Place.publish

    def during(place, name, text):
        seen.append(content(spark, path))  # the new files are there, the manifest is not
        return publish(place, name, text)

    monkeypatch.setattr(snapshots._Place, "publish", during)
    assert snapshots.upsert(rows(spark, (2, "c", 2), (3, "d", 2)), path, ["task_id"]) == 2
    assert seen == [[(1, "a"), (2, "b")]]
    assert sorted((r.task_id, r.value) for r in before.collect()) == [(1, "a"), (2, "b")]  # still the version it opened
    assert content(spark, path) == [(1, "a"), (2, "c"), (3, "d")] and content(spark, path, 1) == [(1, "a"), (2, "b")]


def test_a_killed_write_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.upsert(rows(spark, (1, "a", 1)), path, ["task_id"])

    def killed(place, name, text):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(snapshots._Place, "publish", killed)
        snapshots.upsert(rows(spark, (1, "b", 2)), path, ["task_id"])
    assert content(spark, path) == [(1, "a")]
    assert snapshots.upsert(rows(spark, (1, "c", 3)), path, ["task_id"]) == 2
    assert content(spark, path) == [(1, "c")]
    assert snapshots.vacuum(spark, path, keep=1) == 2 and content(spark, path) == [(1, "c")]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.upsert(rows(spark, (1, "a", 1)), path, ["task_id"])
    publish, others = snapshots._Place.publish, [(2, "other", 1), (3, "third", 1)]

    def overtaken(place, name, text):
        if others:
            item = others.pop()
            snapshots.upsert(rows(spark, item), path, ["task_id"])
        return publish(place, name, text)

    monkeypatch.setattr(snapshots._Place, "publish", overtaken)
    snapshots.upsert(rows(spark, (4, "mine", 1)), path, ["task_id"])
    assert content(spark, path) == [(1, "a"), (2, "other"), (3, "third"), (4, "mine")]


def test_buckets_follow_the_table_and_match_a_dictionary(spark, tmp_path):
    path, rng, held = str(tmp_path / "t"), random.Random(4), {}
    sizes = []
    for turn in range(5):
        items = [(rng.randrange(300), f"{turn}-{i}", turn if rng.random() < .8 else 0) for i in range(120)]
        for k in {i[0] for i in items}:  # the last of equal times is not defined inside one write: keep one
            best = max((i for i in items if i[0] == k), key=lambda i: i[2])
            items = [i for i in items if i[0] != k] + [best]
        for k, v, at in items:
            if k not in held or at >= held[k][1]:
                held[k] = (v, at)
        snapshots.upsert(rows(spark, *items), path, ["task_id"], rows_per_bucket=40)
        now = snapshots.manifest(spark, path)
        sizes.append(now["buckets"])
        assert content(spark, path) == sorted((k, v) for k, (v, _) in held.items())
        assert sum(now["rows"].values()) == len(held) and set(now["folders"]) == set(now["rows"])
    assert sizes == sorted(sizes) and sizes[0] >= 2 and sizes[-1] > sizes[0] and all(n & (n - 1) == 0 for n in sizes)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_parquet(spark.range(100).selectExpr("cast(id as int) task_id", "'a' value", "1 written_at"), path, ["task_id"], buckets=16)
    first = snapshots.manifest(spark, path)
    sinks.upsert_parquet(rows(spark, (5, "b", 2)), path, ["task_id"], buckets=16)
    second = snapshots.manifest(spark, path)
    assert sum(first["folders"][b] != second["folders"][b] for b in first["folders"]) == 1 and len(first["folders"]) == 16


def test_missing_keys_new_columns_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.upsert(rows(spark), path, ["task_id"])
    assert content(spark, path) == []
    snapshots.upsert(rows(spark, (None, "a", 1), (None, "b", 2), (1, None, None)), path, ["task_id"])
    snapshots.upsert(rows(spark, (7, "x", 1)).withColumn("more", F.lit(3)), path, ["task_id"])
    got = {r.task_id: (r.value, r.more) for r in snapshots.read(spark, path).collect()}
    assert got == {None: ("b", None), 1: (None, None), 7: ("x", 3)}


def test_a_batch_of_a_stream_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch, value in ((0, "a"), (1, "b"), (1, "again"), (0, "old"), (2, "c")):
        snapshots.upsert(rows(spark, (1, value, 1)), path, ["task_id"], stream="s", batch=batch)
    assert content(spark, path) == [(1, "c")] and snapshots.manifest(spark, path)["version"] == 3


def feed(spark, source, rng, n, tasks):
    t = dt.datetime(2026, 1, 1)
    events = [(rng.randrange(10**9), rng.randrange(tasks), rng.randrange(10**6), "e",
               rng.choice(["running", "running", "running", "completed", "failed"]), t, 1.0) for _ in range(n)]
    spark.createDataFrame(events, stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return events


def test_states_over_three_micro_batches(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rng, events = random.Random(1), []
    for _ in range(3):
        events += feed(spark, source, rng, 60, 25)
    run = stream.write_latest(stream.read_events(spark, source, per_trigger=1), table, state)
    run.awaitTermination(120)
    want = {}
    for _, task, sequence, _, status, _, _ in events:
        rank = (status in ("completed", "failed"), sequence)
        if task not in want or rank > want[task][0]:
            want[task] = (rank, status)
    got = {r.task_id: (r.sequence, r.status) for r in snapshots.read(spark, table).collect()}
    assert got == {t: (rank[1], status) for t, (rank, status) in want.items()}
    assert snapshots.manifest(spark, table)["version"] == 3
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert kept[-1] == len(want)  # one small state a task


def test_changed_tasks_only_and_expired_states(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    t = dt.datetime(2026, 1, 1)
    seen, kept = [], []
    for events in ([(1, 7, 1, "e", "completed", t, 1.0), (2, 8, 1, "e", "running", t, 1.0)],
                   [(3, 8, 2, "e", "running", t, 1.0), (4, 7, 9, "e", "running", t, 1.0)],
                   [(5, 9, 1, "e", "running", t, 1.0)]):
        spark.createDataFrame(events, stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = []
        with stream.no_idle_batches(spark):
            run = stream.changed_states(stream.read_events(spark, source), expire_ms=1).writeStream.outputMode("update") \
                .foreachBatch(lambda df, _: out.extend((r.task_id, r.sequence) for r in df.collect())) \
                .option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination(120)
        seen.append(sorted(out))
        kept.append([p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]][-1])
    assert seen[0] == [(7, 1), (8, 1)] and (8, 2) in seen[1] and seen[2] == [(9, 1)]
    assert kept[-1] <= 3  # the finished task's state went with its timer


def test_running_states_of_missing_values(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    t = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(1, None, 1, "e", None, t, 1.0), (2, 4, None, "e", "running", t, 1.0), (3, 4, None, "e", "failed", None, None)],
                          stream.EVENT_SCHEMA).coalesce(1).write.parquet(source)
    stream.write_latest(stream.read_events(spark, source), table, state).awaitTermination(120)
    assert sorted((str(r.task_id), r.status) for r in snapshots.read(spark, table).collect()) == [("4", "failed"), ("None", None)]
