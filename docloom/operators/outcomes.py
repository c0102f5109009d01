"""What a run does to a document: one transition table, joined to the outcome of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import writeback

SCHEMA = "outcome string, has_report boolean, has_patch boolean, has_record boolean, failed boolean"
#: What each outcome leaves behind, and whether it marks the document with the error tag. An answer that is no
#: JSON or missing leaves no report, one that breaks the rules does; a dry run leaves nothing but its report and the end of its place in the queue.
TRANSITIONS = (
    ("success", True, True, True, False),
    ("dry_run", True, False, False, False),
    ("invalid", True, False, False, True),
    ("name_gone", True, False, False, True),
    ("empty_content", False, False, False, True),
    ("model_failed", False, False, False, True),
)


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, SCHEMA)


def outcome(asked: Column, raw: Column, errors: Column, dry_run: bool, gone: Column) -> Column:
    """The outcome of a document: the first step that ends its run.

    asked: whether it had a prompt; raw: the answer; errors: of the verdict; gone: whether a name has gone since.
    """
    unread = (F.coalesce(raw, F.lit("")) == "") | F.try_parse_json(raw).isNull()
    return (
        F.when(~asked, "empty_content")
        .when(unread, "model_failed")
        .when(F.size(errors) > 0, "invalid")
        .when(F.lit(dry_run), "dry_run")
        .when(F.coalesce(gone, F.lit(False)), "name_gone")
        .otherwise("success")
    )


def tag_lists(outcomes: DataFrame, current: DataFrame, patches: DataFrame, queue: int, error: int) -> DataFrame:
    """doc_id, outcome and tag_ids, the one final tag list of every document of outcomes.

    Where the transition has a patch its tags hold; elsewhere the document keeps its tags but for those of the
    queue and of errors, and gets the latter if it failed. current: doc_id and tag_ids as they are now.
    """
    rules = transitions(outcomes.sparkSession)
    ruled = outcomes.select("doc_id", "outcome").join(F.broadcast(rules), "outcome")  # one row an outcome
    now = current.select("doc_id", F.col("tag_ids").cast("array<bigint>").alias("now_"))
    new = patches.select("doc_id", F.col("tag_ids").alias("new_"))
    both = ruled.join(now, "doc_id", "left").join(new, "doc_id", "left")
    kept = writeback.queue_tags(F.col("now_"), F.col("failed"), queue, error)
    return both.select("doc_id", "outcome", F.when(F.col("has_patch"), F.col("new_")).otherwise(kept).alias("tag_ids"))
