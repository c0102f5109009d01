"""What goes back to the documents: tags, resolved metadata, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_tags(tags: Column, add: Column | None = None, remove: Column | None = None) -> Column:
    """(tags - remove) + add, sorted and distinct."""
    out = F.coalesce(tags, F.array().cast("array<bigint>"))
    if remove is not None:
        out = F.array_except(out, remove)
    return F.array_sort(F.array_distinct(F.array_union(out, add) if add is not None else out))


def final_tags(tags: Column, managed: Column, chosen: Column, steering: Column) -> Column:
    """Tags after classification: managed ones give way to the chosen ones, steering tags go, others stay."""
    return F.array_sort(F.array_except(F.array_union(F.array_except(tags, managed), chosen), steering))


def queue_tags(tags: Column, failed: Column, queue: int, error: int) -> Column:
    """Tags after a run, a dry one too: the queue tag goes, the error tag marks a failure and goes otherwise."""
    steering = F.array(F.lit(queue), F.lit(error)).cast("array<bigint>")
    return F.when(failed, update_tags(tags, F.array(F.lit(error).cast("bigint")), steering)).otherwise(update_tags(tags, None, steering))


def patch_columns() -> list[Column]:
    """What a patch holds: created only if it is set; a type or correspondent without name is cleared."""
    return [F.trim("title").alias("title"), F.col("document_type_id"), F.col("correspondent_id"), F.col("tag_ids"), F.when(F.col("created") != "", F.col("created")).alias("created")]


def write_back(rows: DataFrame) -> DataFrame:
    """The patch of each valid row."""
    return rows.select("doc_id", *patch_columns())


def seconds(nanoseconds: Column) -> Column:
    return F.round(F.coalesce(nanoseconds, F.lit(0)) / 1e9, 3)


def performance(raw: Column, wall: Column) -> Column:
    """The seven figures of a model's answer (a variant) and of the seconds that it took: times in seconds, tokens as counts; what the answer lacks counts as 0."""
    number = lambda name: F.coalesce(F.try_variant_get(raw, f"$.{name}", "bigint"), F.lit(0).cast("long"))
    return F.struct(
        F.round(wall, 3).alias("wall_seconds"),
        seconds(number("total_duration")).alias("total_seconds"),
        seconds(number("load_duration")).alias("load_seconds"),
        number("prompt_eval_count").alias("prompt_tokens"),
        seconds(number("prompt_eval_duration")).alias("prompt_seconds"),
        number("eval_count").alias("output_tokens"),
        seconds(number("eval_duration")).alias("generation_seconds"),
    )


def run_report(rows: DataFrame, model: str, dry_run: bool) -> DataFrame:
    """One report a document, made before the verdict takes effect, so that invalid runs leave one too."""
    return rows.select(
        "doc_id",
        F.lit(model).alias("model"),
        F.lit(dry_run).alias("dry_run"),
        "content_chars_used",
        "content_truncated",
        F.size("errors").alias("n_errors"),
        F.array_join("errors", ",").alias("validation_errors"),
        seconds(F.col("eval_duration")).alias("eval_seconds"),
    )


def fallback_status(correspondent: Column, enabled: Column, errors: Column, candidate: Column) -> Column:
    """What became of the second stage for a document."""
    return (
        F.when(F.coalesce(correspondent, F.lit("")) != "", "not_needed")
        .when(~enabled, "disabled")
        .when(F.size(errors) > 0, "invalid")
        .when(F.coalesce(candidate, F.lit("")) == "", "empty")
        .otherwise("candidate")
    )
