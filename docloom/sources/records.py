"""Review records from files of one JSON object each: a row a file with its error, and the newest record a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import reviews

#: Versions that are read, and the signature that each must have besides that of the content. Fixed values.
VERSIONS = {2: "document_signature", 3: "document_signature", 4: "prompt_content_signature"}
#: Texts of a record.
TEXTS = ("generated_at", "content_signature", "prompt_content_signature", "document_signature", "correspondent_suggestion")


def record_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every JSON file below path; Spark lists and reads the files in tasks, and passes over files without bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path).select("path", "content")


def read_records(files: DataFrame) -> DataFrame:
    """path, version, document_id, the texts of TEXTS and error of every file of files (path, content).

    error, the first that holds: unreadable (bytes that are no UTF-8, text that is no JSON), version, document_id,
    content_signature, or the signature that the version must have; null for a record that counts.
    """
    raw = F.col("content").cast("string")
    rows = files.select("path", F.when(F.is_valid_utf8(raw), F.try_parse_json(raw)).alias("v"))
    v = F.col("v")

    def string(name: str) -> Column:
        value = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.version", "variant")).isin("BIGINT", "DOUBLE") | F.schema_of_variant(F.try_variant_get(v, "$.version", "variant")).startswith("DECIMAL"), F.try_variant_get(v, "$.version", "double"))
    rows = rows.select("path", "v", number.alias("n_"), F.try_variant_get(v, "$.document_id", "bigint").alias("document_id"), *(string(t).alias(t) for t in TEXTS))
    lacks = F.lit(None).cast("string")
    for version, name in VERSIONS.items():
        lacks = F.when((F.col("n_") == version) & F.col(name).isNull(), name).otherwise(lacks)
    error = (
        F.when(v.isNull(), "unreadable")
        .when(~F.coalesce(F.col("n_").isin(*VERSIONS), F.lit(False)), "version")
        .when(F.col("document_id").isNull(), "document_id")
        .when(F.col("content_signature").isNull(), "content_signature")
        .otherwise(lacks)
    )
    return rows.select("path", F.col("n_").cast("int").alias("version"), "document_id", *TEXTS, error.alias("error"))


def newest(records: DataFrame) -> DataFrame:
    """Of the records without an error the newest of each document (of equal times that of the last path), in the columns that are stored."""
    rest = [c for c in reviews.STORED if c != "document_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("generated_at", F.lit("")), "path"))
    return records.filter("error IS NULL").groupBy("document_id").agg(best.alias("r")).select("document_id", "r.*").select(*reviews.STORED)
