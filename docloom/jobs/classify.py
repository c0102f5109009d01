"""The classification job: prompt, model, verdict, second stage, routing, report, write-back, tags and review record.

A model is an expression over the prompt, such as a pandas UDF; the stub answers from the prompt by fixed rules and
is no classifier. Answers are written once (see `written`) before anything branches on them, so that a model is
asked once a document; prompts and texts are not written. What several later tables need is written too, as a plan
that holds it several times takes the driver's memory. Rows never fail: they carry error codes, and every
document ends with one outcome and one list of tags (see operators/outcomes).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions import prompt, response, text
from docloom.operators import outcomes, reviews, taxonomy, writeback
from docloom.sources.tables import shared_dir

TEMPLATE = "Describe the document below.\nTypes: {{ DOCUMENT_TYPES_JSON }}\nSenders: {{ CORRESPONDENTS_JSON }}\nTags:\n{{ TAGS_LINES }}\n\n{{ DOCUMENT_TEXT }}"
SENDER_TEMPLATE = "Who sent the document below?\n\n{{ DOCUMENT_TEXT }}"
SYSTEM = "Answer with one JSON object that has title, document_type, correspondent, tags and created."
Model = Callable[[Column], Column]


def _answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Takes the title from the text's first line and leaves open what it can't know."""
    for prompts in batches:
        yield prompts.map(lambda p: json.dumps({"title": (p or "").rsplit("\n\n", 1)[-1].strip().split("\n")[0][:80], "document_type": "", "correspondent": "", "tags": [], "created": ""}, ensure_ascii=False))


def stub(user_prompt: Column) -> Column:
    return F.pandas_udf(_answers, StringType())(user_prompt)


#: A model with this mark reads nothing of a prompt but the document's content at its end, and is given only that.
stub.reads_content = True


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the folder that all executors share (spark.checkpoint.dir) and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def preview(docs: DataFrame, dims: DataFrame, template: str = TEMPLATE, limit: int = 40_000, head_ratio: float = 0.7, system: str = SYSTEM) -> DataFrame:
    """docs with content_chars_used, content_truncated and the system_prompt and user_prompt of a configuration; null for an empty content.
    The schema of its answers is the same for all rows: prompt.answer_schema over dims.

    dims: one row with document_types, correspondents and content_tags; its names are part of every prompt. No model is asked.
    """
    return _prompts(docs, dims, {"system_prompt": system, "user_prompt": template}, limit, head_ratio).drop("content_")


def _prompts(docs: DataFrame, dims: DataFrame, templates: dict[str, str], limit: int, head_ratio: float) -> DataFrame:
    """The preview with content_. The taxonomy's slots are filled once, in the row of dims, before it meets the documents; a prompt that nobody reads is not made, and without templates the taxonomy is not read."""
    content, cut = prompt.compact(F.col("text"), limit, head_ratio)
    taxonomy_ = prompt.taxonomy_values(F.col("content_tags"), F.col("document_types"), F.col("correspondents"))
    shared = dims.select(*(value.alias(f"slot_{name}_") for name, value in taxonomy_.items()))
    base = (docs.crossJoin(shared) if templates else docs).withColumn("content_", content).withColumn("content_truncated", cut)  # shared is one row
    values = prompt.document_values(docs.columns, F.col("content_")) | {name: F.col(f"slot_{name}_") for name in taxonomy_}
    return base.select(*docs.columns, "content_", F.length("content_").alias("content_chars_used"), "content_truncated", *(F.when(F.length("content_") > 0, prompt.render(t, values)).alias(name) for name, t in templates.items()))


def ask(docs: DataFrame, dims: DataFrame, model: Model = stub, limit: int = 40_000, head_ratio: float = 0.7) -> DataFrame:
    """The preview with asked and the raw answer; none is asked for an empty content. What reads neither the prompt nor an answer made of it does not make it."""
    return _asked(docs, dims, model, {"user_prompt": TEMPLATE}, limit, head_ratio)


def _asked(docs: DataFrame, dims: DataFrame, model: Model, templates: dict[str, str], limit: int = 40_000, head_ratio: float = 0.7) -> DataFrame:
    seen = F.col("content_" if getattr(model, "reads_content", False) else "user_prompt")
    asked = _prompts(docs, dims, templates, limit, head_ratio).withColumn("asked", F.length("content_") > 0)
    return asked.withColumn("raw", F.when(F.col("asked"), model(seen))).drop("content_")


def classify(docs: DataFrame, dims: DataFrame, model: Model = stub, limit: int = 40_000, head_ratio: float = 0.7) -> DataFrame:
    """doc_id, prompt figures and the raw answer of every document with a content."""
    return ask(docs, dims, model, limit, head_ratio).filter("asked").select("doc_id", "content_chars_used", "content_truncated", "raw")


def judge(answers: DataFrame, types: DataFrame, correspondents: DataFrame, tags: DataFrame, max_tags: int = 5) -> DataFrame:
    """answers (doc_id, raw, ..., parsed already if they have response_) with the fields and the error codes. The dimensions have id and name."""
    parsed = answers if "response_" in answers.columns else response.fields(answers, normalize=True)
    judged = response.judged(parsed, ["doc_id"], types, correspondents, tags, max_tags)
    r = F.col("response_")
    return judged.select(
        *(c for c in answers.columns if c != "response_"),
        *(r[n].alias(n) for n in ("title", "document_type", "correspondent")),
        F.coalesce(r["tags"], F.array().cast("array<string>")).alias("tags"),
        r["created"].alias("created"),
        F.when(F.col("raw").isNull(), F.array(F.lit("empty_content"))).otherwise(F.col("errors")).alias("errors"),
    )


def second_stage(judged: DataFrame, docs: DataFrame, correspondents: DataFrame, model: Model, enabled: bool = True) -> DataFrame:
    """judged with fallback_status, candidate_kind and pending; a candidate that is a known name becomes the correspondent.

    Only valid rows without a correspondent are asked, with their texts from docs; an error of this stage is a status
    and leaves the row valid.
    """
    valid = F.size("errors") == 0
    needed = valid & (F.coalesce("correspondent", F.lit("")) == "") & F.lit(enabled)
    content, _ = prompt.compact(F.col("text"), 12_000, 0.7)
    sent = docs.join(judged.filter(needed).select("doc_id").hint("merge"), "doc_id", "left_semi").withColumn("prompt_", prompt.render(SENDER_TEMPLATE, {"DOCUMENT_TEXT": content}))
    asked = judged.join(sent.select("doc_id", model(F.col("prompt_")).alias("raw_sender_")), "doc_id", "left")
    asked = asked.withColumn("sender_errors_", F.when(needed, response.correspondent_errors(F.col("raw_sender_"))).otherwise(F.array().cast("array<string>")))
    found = F.when(needed & (F.size("sender_errors_") == 0), response.text_field(response.parse(F.col("raw_sender_")), "correspondent"))
    asked = asked.withColumn("candidate_", text.collapse(F.coalesce(found, F.lit(""))))
    status = F.when(~valid, "skipped_main_invalid").otherwise(writeback.fallback_status(F.col("correspondent"), F.lit(enabled), F.col("sender_errors_"), F.col("candidate_")))
    routed = taxonomy.route_candidates(asked.withColumn("fallback_status", status), correspondents, "candidate_")
    known = F.coalesce("matched_existing", "correspondent")
    return routed.select(*(known.alias(c) if c == "correspondent" else F.col(c) for c in judged.columns), "fallback_status", "candidate_kind", "pending")


def tag_ids(judged: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_id and chosen, the ids of the tags that each row names (of equal names the smallest id)."""
    ids = tags.groupBy("name").agg(F.min("id").alias("id"))
    named = judged.select("doc_id", F.explode("tags").alias("name")).join(ids, "name")
    return named.groupBy("doc_id").agg(F.array_sort(F.collect_set("id")).alias("chosen"))


def apply(judged: DataFrame, current: DataFrame, types: DataFrame, correspondents: DataFrame, tags: DataFrame, steering: list[int]) -> DataFrame:
    """The patches of the valid rows, and error where a name has gone since the verdict.

    current: doc_id and tag_ids as they are now. Content tags give way to the chosen ones, steering tags go, all
    other tags stay. One document is one row.
    """
    good = judged.filter(F.size("errors") == 0)
    typed = taxonomy.resolve_ids(good, types, "document_type", "document_type_id").withColumnRenamed("error", "type_error_")
    named = taxonomy.resolve_ids(typed, correspondents, "correspondent", "correspondent_id").withColumn("error", F.coalesce("error", "type_error_")).drop("type_error_")
    # Tags of the taxonomy that a document has now are found by a join, like those that it gets.
    owned = current.select("doc_id", F.explode("tag_ids").alias("id")).join(tags.select("id").distinct(), "id").groupBy("doc_id").agg(F.collect_set("id").alias("managed"))
    with_tags = named.join(tag_ids(good, tags), "doc_id", "left").join(current.select("doc_id", F.col("tag_ids").alias("now_")), "doc_id", "left").join(owned, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    list_of = lambda c: F.coalesce(F.col(c).cast("array<bigint>"), none)
    new = writeback.final_tags(list_of("now_"), list_of("managed"), list_of("chosen"), F.array(*(F.lit(t).cast("bigint") for t in steering)) if steering else none)
    patches = with_tags.withColumn("tag_ids", new)
    return patches.select("doc_id", "error", *writeback.patch_columns())


class Outcome(NamedTuple):
    """What a run leaves behind."""

    reports: DataFrame
    patches: DataFrame
    records: DataFrame
    tags: DataFrame


def run(docs: DataFrame, dims: DataFrame, types: DataFrame, correspondents: DataFrame, tags: DataFrame, current: DataFrame, model: Model, sender_model: Model, queue: int, error: int, max_tags: int = 5, dry_run: bool = False, generated_at: Column | None = None, types_now: DataFrame | None = None, correspondents_now: DataFrame | None = None) -> Outcome:
    """Reports of all documents that got an answer, patches and review records of those that are applied, and the
    tags of every document.

    queue and error are the ids of the steering tags. The outcome of a document decides what it gets: see
    outcomes.TRANSITIONS. generated_at: the records' time, now if not given. types_now, correspondents_now: the
    dimensions as they are when answers take effect; a name that they lack by then ends a run.
    """
    templates = {} if getattr(model, "reads_content", False) else {"user_prompt": TEMPLATE}
    asked = _asked(docs, dims, model, templates).select("doc_id", "content_chars_used", "content_truncated", "raw", "asked")
    answers = written(response.fields(asked, normalize=True), "answers")  # parsed once
    verdicts = written(judge(answers, types, correspondents, tags, max_tags), "verdicts")
    judged = written(second_stage(verdicts, docs, correspondents, sender_model), "judged")
    patched = written(apply(judged, current, types if types_now is None else types_now, correspondents if correspondents_now is None else correspondents_now, tags, [queue, error]), "patched")
    gone = patched.select("doc_id", F.col("error").isNotNull().alias("gone_"))
    ended = judged.join(gone, "doc_id", "left").withColumn("outcome", outcomes.outcome(F.col("asked"), F.col("raw"), F.col("errors"), dry_run, F.col("gone_")))
    ended = written(ended.join(F.broadcast(outcomes.transitions(docs.sparkSession)), "outcome").drop("gone_", "raw"), "outcomes")
    reports = ended.filter("has_report").select("doc_id", "outcome", "content_chars_used", "content_truncated", F.array_join("errors", ",").alias("validation_errors"), "fallback_status", "candidate_kind", "pending")
    patches = patched.join(ended.filter("has_patch").select("doc_id"), "doc_id", "left_semi").drop("error")
    recorded = docs.select("doc_id", "text").join(ended.filter("has_record").select("doc_id", "pending").hint("merge"), "doc_id")  # both sides grow with the documents
    records = reviews.storable(reviews.review_records(recorded, F.col("pending"), generated_at=generated_at))
    return Outcome(reports, patches, records, outcomes.tag_lists(ended, current, patches, queue, error))
