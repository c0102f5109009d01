"""The polling loop: a queue drained by beats, beats that run again, pruning by the clock."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import reviews
from docloom.streaming import polling

QUEUE, ERROR, REVIEW = 1, 2, 3
SETTINGS = polling.Settings(QUEUE, ERROR, REVIEW, 20, 3600)


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def loop_of(spark, folder, n=50, settings=SETTINGS):
    rows = [(k, at(n - k), [QUEUE, 10 + k] + [REVIEW] * (k % 2)) for k in range(n)]
    base = spark.createDataFrame(rows, "doc_id long, added timestamp, tag_ids array<long>")
    done = []

    def process(session, due):
        ids = [r.doc_id for r in due.orderBy("added").collect()]
        done.append(ids)
        keep = F.filter("tag_ids", lambda t: t != QUEUE)
        records = due.select(F.lit(4).alias("version"), F.col("doc_id").alias("document_id"), F.lit("t").alias("generated_at"), *(F.lit("x").alias(c) for c in reviews.STORED[3:]))
        return polling.Work(due.select("doc_id", keep.alias("tag_ids")), records)

    return polling.Loop(str(folder), lambda s: base, process, settings), done


def beat(spark, loop, number, minute):
    loop.beat(spark.createDataFrame([(at(minute),)], "timestamp timestamp"), number)


@pytest.mark.parametrize("compact", [50, 2])
def test_beats_drain_the_queue(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(polling, "COMPACT", compact)
    for k in range(3):
        spark.createDataFrame([(at(k),)], "timestamp timestamp").coalesce(1).write.parquet(f"{tmp_path}/beats/{k}")
    loop, done = loop_of(spark, tmp_path / "loop")
    loop.start(polling.beats_of(spark, f"{tmp_path}/beats/*")).awaitTermination()
    assert [len(x) for x in done] == [20, 20, 10] and done[0][0] == 49  # the oldest first
    assert sorted(sum(done, [])) == list(range(50))
    assert all(QUEUE not in r.tag_ids and 10 + r.doc_id in r.tag_ids for r in loop.tags(spark, 3).collect())
    beat(spark, loop, 3, 3)
    assert done[-1] == [] and loop.tags(spark, 4).count() == 50


def test_the_queue_of_a_beat_is_read_once(spark, tmp_path):
    loop, done = loop_of(spark, tmp_path)
    inner, plans = loop.process, []
    loop.process = lambda s, due: plans.append(due._jdf.queryExecution().optimizedPlan().toString()) or inner(s, due)
    beat(spark, loop, 0, 0)
    assert len(done[0]) == 20 and plans[0].startswith("Relation [") and "Join" not in plans[0]


def test_a_beat_that_runs_again_changes_nothing(spark, tmp_path):
    loop, done = loop_of(spark, tmp_path)
    beat(spark, loop, 0, 0)
    beat(spark, loop, 1, 1)
    state = lambda: (sorted(map(str, loop.tags(spark, 2).collect())), sorted(map(str, loop.records(spark, 2).collect())), loop.clock(spark, 2))
    first = state()
    beat(spark, loop, 1, 1)
    assert state() == first and done[1] == done[2] and not set(done[0]) & set(done[1])


def test_records_are_pruned_by_the_clock(spark, tmp_path):
    loop, done = loop_of(spark, tmp_path, 50, SETTINGS._replace(page=10))
    kept = []
    for number, minute in enumerate([0, 20, 59, 60, 70]):
        beat(spark, loop, number, minute)
        kept.append({r.document_id for r in loop.records(spark, number + 1).collect()})
    written = [set(x) for x in done]
    odd = lambda s: {k for k in s if k % 2}
    assert kept[0] == written[0] and kept[2] == written[0] | written[1] | written[2]
    assert kept[3] == odd(written[0] | written[1] | written[2]) | written[3]  # an hour after the first
    assert kept[4] == kept[3] | written[4]


def test_an_empty_loop(spark, tmp_path):
    loop, done = loop_of(spark, tmp_path, 0)
    loop.beat(spark.createDataFrame([], "timestamp timestamp"), 0)
    assert done == [[]] and loop.clock(spark, 1) == (None, None)
