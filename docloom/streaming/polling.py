"""The polling loop as a stream of beats: each beat takes the oldest queued documents through the job.

A beat is a micro-batch of a heartbeat stream, whose largest time is the loop's clock. What beats leave behind are
tables in folders by their number; a beat reads the numbers below its own and overwrites its own, so one that is
run again after a failure finds the same queue and writes the same rows, and nothing is applied twice.

Tags are a base table, to which others may add documents, and the changes of the beats; every COMPACT beats these are
folded into one table, so a beat reads few small tables whatever its number. Records are a snapshot a beat, as
large as the inbox. They are pruned by the loop's clock, not by its beats: then records stay whose documents have
the review tag, and those that the beat itself writes.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docloom.operators import reviews
from docloom.sources.tables import queue

#: Documents of a beat, and beats between two foldings of the changes.
PAGE, COMPACT = 20, 50
CHANGES = "doc_id long, tag_ids array<long>, beat int"
RECORDS = "version int, document_id long, generated_at string, content_signature string, prompt_content_signature string, correspondent_suggestion string"
CLOCK = "at timestamp, pruned_at timestamp"


class Settings(NamedTuple):
    """Ids of the steering tags, documents of a beat, and seconds between two prunings of the records."""

    queue_tag: int
    error_tag: int
    review_tag: int
    page: int = PAGE
    prune_seconds: int = 3600


class Work(NamedTuple):
    """What a beat has done to its documents: tags of all of them, records of those that were applied."""

    tags: DataFrame
    records: DataFrame


#: Takes the documents of a beat (doc_id, added, tag_ids) through the job, with the taxonomy as it is then.
Process = Callable[[SparkSession, DataFrame], Work]


class Loop:
    """The tables of one loop in folder; base gives doc_id, added and tag_ids of all documents, as they come in."""

    def __init__(self, folder: str, base: Callable[[SparkSession], DataFrame], process: Process, settings: Settings):
        self.folder, self.base, self.process, self.settings = folder.rstrip("/"), base, process, settings

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/{number}"

    def _read(self, spark: SparkSession, kind: str, schema: str, number: int) -> DataFrame:
        """What the beats from the last folding up to number (exclusive) have left."""
        folded = (number - 1) // COMPACT * COMPACT if number else 0
        paths = [self._path(kind, n) for n in range(folded, number)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def tags(self, spark: SparkSession, number: int) -> DataFrame:
        """doc_id, added and tag_ids of all documents before beat number."""
        changed = self._read(spark, "tags", CHANGES, number).groupBy("doc_id").agg(F.max_by("tag_ids", "beat").alias("new_"))
        now = self.base(spark).join(changed, "doc_id", "left")
        return now.select("doc_id", "added", F.coalesce("new_", F.col("tag_ids")).alias("tag_ids"))

    def records(self, spark: SparkSession, number: int) -> DataFrame:
        """The review records before beat number, one a document."""
        last = number - 1
        return spark.read.schema(RECORDS).parquet(self._path("records", last)) if number else spark.createDataFrame([], RECORDS)

    def clock(self, spark: SparkSession, number: int) -> tuple[datetime | None, datetime | None]:
        """Time of the beat before number, and of the last pruning."""
        row = spark.read.schema(CLOCK).parquet(self._path("clock", number - 1)).first() if number else None
        return (row["at"], row["pruned_at"]) if row else (None, None)

    def beat(self, beats: DataFrame, number: int, time_col: str = "timestamp") -> None:
        """One beat, as foreachBatch calls it."""
        spark, s = beats.sparkSession, self.settings
        at = beats.agg(F.max(time_col)).first()[0]  # one value
        before, pruned_at = self.clock(spark, number)
        at = at or before
        tags = self.tags(spark, number)
        queue(tags, s.queue_tag, s.page, "tag_ids", ("added", "doc_id")).write.mode("overwrite").parquet(self._path("due", number))
        work = self.process(spark, spark.read.schema(tags.schema).parquet(self._path("due", number)))  # the queue is read once a beat
        changes = work.tags.select("doc_id", F.col("tag_ids").cast("array<long>").alias("tag_ids"), F.lit(number).alias("beat"))
        if number and number % COMPACT == 0:  # this beat's table holds all changes so far
            older = self._read(spark, "tags", CHANGES, number).groupBy("doc_id").agg(F.max_by(F.struct("tag_ids", "beat"), "beat").alias("x")).select("doc_id", "x.*")
            changes = older.join(changes.select("doc_id"), "doc_id", "left_anti").unionByName(changes)
        changes.write.mode("overwrite").parquet(self._path("tags", number))
        records = reviews.upsert(self.records(spark, number), work.records.select(*reviews.STORED))
        if at is not None and (pruned_at is None or (at - pruned_at).total_seconds() >= s.prune_seconds):
            # As in a listing of the inbox: with the tags that the beat found.
            inbox = tags.filter(F.array_contains("tag_ids", s.review_tag)).select(F.col("doc_id").alias("document_id"))
            fresh = work.records.select("document_id")
            records = records.join(inbox.union(fresh), "document_id", "left_semi")
            pruned_at = at
        records.select(*reviews.STORED).write.mode("overwrite").parquet(self._path("records", number))
        spark.createDataFrame([(at, pruned_at)], CLOCK).coalesce(1).write.mode("overwrite").parquet(self._path("clock", number))

    def start(self, beats: DataFrame, seconds: int | None = None) -> StreamingQuery:
        """The loop over a stream of beats: every so many seconds, or once over all beats that there are."""
        writer = beats.writeStream.foreachBatch(self.beat).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def heartbeat(spark: SparkSession) -> DataFrame:
    """One row a second; a slow beat covers the rows that have come meanwhile."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select("timestamp")


def beats_of(spark: SparkSession, folder: str, schema: str = "timestamp timestamp") -> DataFrame:
    """Files of times as a stream, one file a beat."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
