"""Review records: built from documents, matched by content signature, resolved and pruned. All matches fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text

#: Longest candidate that a record may carry.
MAX_CANDIDATE = 255
#: Version of new records, and what is stored of one.
VERSION = 4
STORED = ("version", "document_id", "generated_at", "content_signature", "prompt_content_signature", "correspondent_suggestion")


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col with the weak and the strong signature of every document."""
    return docs.select(id_col, text.content_signature(F.col(text_col)).alias("content_signature"), text.prompt_content_signature(F.col(text_col)).alias("prompt_content_signature"))


def now_text() -> Column:
    """The present time as records carry it."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def review_records(docs: DataFrame, candidate: Column | None = None, id_col: str = "doc_id", text_col: str = "text", generated_at: Column | None = None) -> DataFrame:
    """Records of the current version; a candidate that is too long makes an error instead of a record."""
    clean = text.collapse(candidate) if candidate is not None else F.lit("")
    return docs.select(
        F.lit(VERSION).alias("version"),
        F.col(id_col).alias("document_id"),
        (now_text() if generated_at is None else generated_at).alias("generated_at"),
        text.content_signature(F.col(text_col)).alias("content_signature"),
        text.prompt_content_signature(F.col(text_col)).alias("prompt_content_signature"),
        clean.alias("correspondent_suggestion"),
        F.when(F.length(clean) > MAX_CANDIDATE, "candidate_too_long").alias("error"),
    )


def storable(records: DataFrame) -> DataFrame:
    """The records without an error, in the columns that are stored."""
    return records.filter("error IS NULL").select(*STORED)


def upsert(records: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot of records after new ones are written: one a document, the one generated last; of equal times a new one."""
    both = records.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    rest = [c for c in records.columns if c != "document_id"]
    newest = F.max_by(F.struct(*rest), F.struct("generated_at", "new_"))
    return both.filter(F.col("document_id").isNotNull()).groupBy("document_id").agg(newest.alias("r")).select("document_id", "r.*")


def _by(pairs: DataFrame, key: str, stem: str) -> DataFrame:
    return pairs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("n_").alias(f"n_{stem}"), F.min("id_").alias(f"{stem}_id"))


def match_records(queries: DataFrame, records: DataFrame) -> DataFrame:
    """queries with matched_document_id and match.

    A single record with the strong signature matches; several are ambiguous for good. Without any the weak
    signature decides by the same rule. Records are counted by both signatures once and summed up by each, so a
    signature that many records share costs one row.
    """
    pairs = records.groupBy("prompt_content_signature", "content_signature").agg(F.count(F.lit(1)).alias("n_"), F.min("document_id").alias("id_"))
    strong, weak = _by(pairs, "prompt_content_signature", "strong"), _by(pairs, "content_signature", "weak")
    both = queries.join(strong, "prompt_content_signature", "left").join(weak, "content_signature", "left")
    n_strong, n_weak = F.coalesce("n_strong", F.lit(0)), F.coalesce("n_weak", F.lit(0))
    matched = F.when(n_strong == 1, F.col("strong_id")).when((n_strong == 0) & (n_weak == 1), F.col("weak_id"))
    many = lambda name, n: F.concat(F.lit(f"{name} ambiguous ("), n.cast("string"), F.lit(")"))
    why = (
        F.when(n_strong == 1, "prompt_content_signature")
        .when(n_strong > 1, many("prompt_content_signature", n_strong))
        .when(n_weak == 1, "content_signature")
        .when(n_weak > 1, many("content_signature", n_weak))
        .otherwise("no review record")
    )
    return both.select(*queries.columns, matched.alias("matched_document_id"), why.alias("match"))


def resolve_ambiguous(queries: DataFrame, records: DataFrame, live: DataFrame) -> DataFrame:
    """queries, those of a weak signature that several records share, against what the records' documents hold now.

    live: document_id and prompt_content_signature of the present contents. Exactly one of the records'
    documents must have the query's strong signature. Candidates are counted by both signatures, not paired.
    """
    weak = records.groupBy("content_signature").agg(F.count(F.lit(1)).alias("n_records"))
    now = records.select("document_id", "content_signature").join(live.select("document_id", "prompt_content_signature"), "document_id")
    now = now.groupBy("content_signature", "prompt_content_signature").agg(F.count(F.lit(1)).alias("n_live"), F.min("document_id").alias("live_id"))
    both = queries.join(weak, "content_signature").filter("n_records > 1").join(now, ["content_signature", "prompt_content_signature"], "left")
    n = F.coalesce("n_live", F.lit(0))
    why = (
        F.when(n == 1, "content_signature + live prompt_content_signature")
        .when(n > 1, F.concat(F.lit("content+prompt ambiguous ("), n.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("content_signature ambiguous ("), F.col("n_records").cast("string"), F.lit("); no unique exact prompt-content match")))
    )
    return both.select(*queries.columns, F.when(n == 1, F.col("live_id")).alias("matched_document_id"), why.alias("match"))


def prune(records: DataFrame, inbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose document is still in the inbox, and the others, which go."""
    ids = inbox.select(F.col("document_id").alias("inbox_id"))
    on = F.col("document_id") == F.col("inbox_id")
    return records.join(ids, on, "left_semi"), records.join(ids, on, "left_anti")
