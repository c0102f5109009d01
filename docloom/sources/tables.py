"""Where tables come from: Parquet tables of a folder, and the work queue."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only in a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queue(docs: DataFrame, tag: int, most: int = 20, tags_col: str = "tags", order: tuple[str, str] = ("added", "id")) -> DataFrame:
    """The oldest documents that carry the queue tag."""
    return docs.filter(F.array_contains(tags_col, tag)).orderBy(*order).limit(most)


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids, each once, and found: false for an id that has none."""
    wanted = ids.select(F.col(key)).filter(F.col(key).isNotNull()).distinct()
    return wanted.join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
