"""Retry state over a stream of attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import recovery


def retry_batches(out: str, state: str, retryable: Column, failed: Column, key: str = "user_id", ts: str = "ts", tie: str = "event_id", delays: tuple[int, ...] = recovery.DELAYS) -> Callable[[DataFrame, int], None]:
    """What to do with each micro-batch of attempts: their numbers and outcomes go to out/batch=N.

    The state is a table of the keys that wait, written anew by each batch to one of two folders in turn: a batch reads
    what the one before wrote, so one that is run again after a failure overwrites its own results with the same
    rows. Window expressions do the counting, so Spark sorts and spills a frequent key. Attempts of a key must
    arrive in order across batches; inside a batch they are sorted.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = f"`{key}` {batch.schema[key].dataType.simpleString()}, waiting int"
        before = spark.read.schema(waiting).parquet(f"{state}/{(number - 1) % 2}") if number else spark.createDataFrame([], waiting)
        joined = batch.join(before, key, "left")
        scheduled = recovery.retry_schedule(joined, key, ts, tie, retryable, failed, delays, F.coalesce("waiting", F.lit(0))).drop("waiting")
        scheduled.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done = spark.read.schema(scheduled.schema).parquet(f"{out}/batch={number}")
        last = done.groupBy(key).agg(F.max_by(F.when(F.col("status") == "waiting", F.col("attempt")).otherwise(0), F.struct(ts, tie)).alias("waiting"))
        after = before.join(last, key, "left_anti").unionByName(last.filter("waiting > 0"))
        after.write.mode("overwrite").parquet(f"{state}/{number % 2}")

    return work


def read_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Event files as a stream."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there in batches, then stop."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
