"""From raw documents to sampled training pieces, in five stages.

Each stage is written as Parquet to the shared folder and read again as the next one's input. All but the last
return the columns of documents, and further columns are carried.

Nulls and edge cases: a null text fails the quality rules, as an empty one does; a null id never groups with
others; rows that repeat with their id stay or go together; an empty table gives an empty result in every
stage; a null language is a language of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import minhash, mixing, pii, quality, sentence_pieces
from docloom.llm.common import store
from docloom.llm.queries import vocabulary

#: Shares of the tokens after mixing: toxic texts are held down, low quality is what the first stage removes.
#: No document is dropped for it: the clean ones are repeated, mixing.MOST_TIMES times at most.
WEIGHTS = {"clean": 0.92, "low": 0.0, "toxic": 0.08}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality rules reject go."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 80 % of five-word shingles one document stays."""
    return minhash.deduplicate(docs, width=5, percent=80, bands=32, rows=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the domains have their target shares; none is dropped."""
    return mixing.apply_rates(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what is left; the copies of a document are drawn each by itself."""
    return sentence_pieces.sample_copies(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("sentence_pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs


#: The stages hash, fit and sample; the tests hold them against plain versions instead.
ORACLE_SQL = None
