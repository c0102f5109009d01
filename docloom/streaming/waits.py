"""Waits between attempts as a stateful stream: attempts and triggers come in one stream, timers end what nobody asks for.

A retryable failure waits for the delay of its attempt. The wait ends at its deadline, or at the first trigger that comes
while the key waits. What recovery.waits finds in a whole table, the stream tells as soon as it is known: at a
trigger, at the key's next attempt, or when the watermark passes the deadline and the key's timer fires.

A key's state is how many waits its request has behind it and the wait that is open; success and final failure end
the request and clear the state. A request that is never taken up again is forgotten some time after its last deadline
if forget_seconds is given. State and timers are in the checkpoint, so a stream that is started again goes on as if nothing had been.

Rows of a key must not come later than the watermark allows; inside a batch they are sorted by key, so
a batch bounds what a key's rows take in memory (maxFilesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from docloom.operators import recovery

#: Kinds of rows. A tick only moves the watermark.
RETRYABLE, ENDED, TRIGGER, TICK = "retryable", "ended", "trigger", "tick"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key long, event_id long, ended_us long, ended_by string"
SECOND = 1_000_000


class Waits(StatefulProcessor):
    """The open request of each key. Times are microseconds."""

    def __init__(self, delays: tuple[int, ...] = recovery.DELAYS, forget_seconds: int | None = None):
        self.delays, self.forget_seconds = delays, forget_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: due is null when no wait is open; timer is the time in milliseconds that the key has a timer for.
        self.request = handle.getValueState("request", "waits int, event_id long, due long, timer long")

    def _read(self) -> tuple:
        return tuple(self.request.get()) if self.request.exists() else (0, None, None, None)

    def _write(self, waits: int, event_id: int | None, due: int | None, timer: int | None, old: int | None) -> None:
        if old is not None and old != timer:
            self.handle.deleteTimer(old)
        if timer is not None and old != timer:
            self.handle.registerTimer(timer)
        if waits or due is not None:
            self.request.update((waits, event_id, due, timer))
        else:
            self.request.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waits, event_id, due, old = self._read()
        found = [(r.us, r.kind == TRIGGER, r.event_id, r.kind) for r in rows if r.kind != TICK]
        if not found:
            return
        for us, asked, number, kind in sorted(found, key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2])):
            if due is not None:
                early = asked and us < due
                if early or us >= due or not asked:
                    yield Row(key=key[0], event_id=event_id, ended_us=us if early else due, ended_by="trigger" if early else "deadline")
                    event_id = due = None
            if asked:
                continue
            waits = waits + 1 if kind == RETRYABLE and waits < len(self.delays) else 0
            if waits:
                event_id, due = number, us + self.delays[waits - 1] * SECOND
        self._write(waits, event_id, due, self._timer(due, waits, max(f[0] for f in found)), old)

    def _timer(self, due: int | None, waits: int, us: int) -> int | None:
        """Milliseconds at which something is to be done about the key without any row: the deadline, or to forget it."""
        if due is not None:
            return -(-due // 1000)
        if waits and self.forget_seconds is not None:
            return -(-us // 1000) + 1000 * self.forget_seconds
        return None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waits, event_id, due, timer = self._read()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if timer != at:  # replaced meanwhile
            return
        if due is None:
            self.request.clear()
            return
        yield Row(key=key[0], event_id=event_id, ended_us=due, ended_by="deadline")
        later = self._timer(None, waits, due)
        if later is not None:
            self.handle.registerTimer(later)
        self.request.update((waits, None, None, later))

    def close(self) -> None:
        pass


def ended_waits(rows: DataFrame, key: str, ts: str, tie: str, kind: Column, late: str = "1 second", delays: tuple[int, ...] = recovery.DELAYS, forget_seconds: int | None = None) -> DataFrame:
    """key, tie, ended_at and ended_by of every wait of a stream of attempts and triggers, each once it is over."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    marked = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("event_id"), kind.alias("kind"))
    marked = marked.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    ended = marked.groupBy("key").transformWithState(statefulProcessor=Waits(delays, forget_seconds), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
    return ended.select(F.col("key").alias(key), F.col("event_id").alias(tie), F.timestamp_micros("ended_us").cast(rows.schema[ts].dataType).alias("ended_at"), "ended_by")


def write(ended: DataFrame, folder: str) -> StreamingQuery:
    """The ended waits as Parquet files in folder/out, each once, over all that is there now."""
    writer = ended.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.outputMode("append").trigger(availableNow=True).start()
