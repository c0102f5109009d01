"""Helpers that the operators share: the shared folder, lineage cuts and Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
BLOCK_BYTES = 1 << 18
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 2 << 20


#: Folders that store has written.
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one of our own only in a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_stored(spark: SparkSession) -> None:
    """Delete all that store has written in this session: for a job to call once its results are written."""
    jvm = spark.sparkContext._jvm
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """df, in a session whose Arrow batches are bounded in bytes and not by rows alone: texts can be long.

    Spark has this bound for a session only and reads it when the plan runs, so it stays set.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1)).rstrip("bB")) > most:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def release_memory() -> None:
    """Hand a worker's free memory back, as idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have, whatever the case of its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most block_bytes of text (one row at least), with bytes and offsets."""
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + block_bytes, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
        del batch, data, at
    release_memory()
