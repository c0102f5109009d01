"""Waits as a stateful stream: equal to the batch form, whatever the files and restarts, and no state of finished keys."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import recovery
from docloom.streaming import waits

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def kind():
    return F.when(F.col("event_type") == "view", waits.TRIGGER).when(F.col("event_type") == "error", waits.RETRYABLE).when(F.col("event_type") == "tick", waits.TICK).otherwise(waits.ENDED)


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def events_of(n, seed=2):
    r, out = random.Random(seed), []
    for k in range(n):
        out.append((k, at(k * 7 + (0 if k % 9 else 7)), r.randint(1, 9), r.choice(["error"] * 5 + ["view"] * 3 + ["signup", "buy"])))
    return out


def streamed(spark, rows, folder, files, restart, end=10**6, **how):
    """The ended waits after the rows came in so many files; restart: the stream begins anew for each."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + ([[(None, at(end), None, "tick")]] if end else [])
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")
        if restart or k == len(parts) - 1:
            waits.write(waits.ended_waits(stream, "user_id", "ts", "event_id", kind(), **how), str(folder)).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return sorted((r.event_id, r.ended_at, r.ended_by) for r in out.collect())


def state(spark, folder):
    rows = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "request").load()
    return {r["key"]["key"]: r["value"]["waits"] for r in rows.collect()}


@pytest.mark.parametrize("files,restart", [(1, False), (4, True)])
def test_the_stream_equals_the_batch(spark, tmp_path, files, restart):
    rows = events_of(250)
    df = spark.createDataFrame(rows, SCHEMA)
    scheduled = recovery.retry_schedule(df.filter("event_type <> 'view'"), "user_id", "ts", "event_id", F.col("event_type") == "error", F.lit(False))
    want = recovery.waits(scheduled, df.filter("event_type = 'view'").select("user_id", "ts"), "user_id", "ts", "event_id")
    assert streamed(spark, rows, tmp_path, files, restart) == sorted((r.event_id, r.ended_at, r.ended_by) for r in want.collect())
    last = {}
    for r in scheduled.orderBy("ts", "event_id").collect():
        last[r.user_id] = r.attempt if r.status == "waiting" else 0
    assert state(spark, tmp_path) == {k: n for k, n in last.items() if n}  # finished keys hold none


def test_requests_are_forgotten(spark, tmp_path):
    rows = [(1, at(0), 7, "error"), (2, at(1), 8, "error"), (3, at(2), 8, "buy"), (4, at(5000), 9, "buy")]
    assert streamed(spark, rows, tmp_path, 2, True, 10**5, forget_seconds=600) == [(1, at(15), "deadline"), (2, at(16), "deadline")]
    assert state(spark, tmp_path) == {}


def test_nothing_is_told_before_it_is_known(spark, tmp_path):
    rows = [(1, at(0), 7, "error"), (2, at(3), 7, "view"), (3, at(4), 8, "error")]
    assert streamed(spark, rows, tmp_path, 1, True, 0) == [(1, at(3), "trigger")]
