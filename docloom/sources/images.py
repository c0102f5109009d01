"""Page images: files with their kinds and limits, sizes and resolutions from their headers, and what an engine reads in them.

Only headers are parsed, so no pixel is decoded for a size. An engine is opened once a task, reads one image at a
time, and is closed at the task's end, whatever happens.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are kept; any other counts as png. Largest image in bytes, and the resolution of images that name none. Fixed values.
SUFFIXES, MAX_BYTES, DEFAULT_DPI = ("png", "jpg", "jpeg", "tif", "tiff", "bmp"), 100 << 20, 300.0
#: Rows of an Arrow batch of images, which are large.
BATCH_ROWS = 16
Header = tuple[int, int, float | None, float | None]


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, content and error (too_large, whose content is not read) of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(""))
    large = F.col("length") > MAX_BYTES
    return files.select("path", F.when(suffix.isin(*SUFFIXES), suffix).otherwise("png").alias("suffix"), F.when(~large, F.col("content")).alias("content"), F.when(large, "too_large").alias("error"))


def _png(data: bytes) -> Header:
    width, height = struct.unpack(">II", data[16:24])
    at, dpi = 8, (None, None)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"pHYs" and at + 17 <= len(data):
            x, y, unit = struct.unpack(">IIB", data[at + 8 : at + 17])
            dpi = (x * 0.0254, y * 0.0254) if unit == 1 else dpi
        if kind in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return width, height, *dpi


def _tiff(data: bytes) -> Header:
    order = "<" if data[:2] == b"II" else ">"
    first = struct.unpack(order + "I", data[4:8])[0]
    found: dict[int, float] = {}
    for k in range(struct.unpack(order + "H", data[first : first + 2])[0]):
        entry = data[first + 2 + 12 * k : first + 14 + 12 * k]
        tag, kind, _ = struct.unpack(order + "HHI", entry[:8])
        if kind == 3:
            found[tag] = struct.unpack(order + "H", entry[8:10])[0]
        elif kind == 4:
            found[tag] = struct.unpack(order + "I", entry[8:12])[0]
        elif kind == 5:
            at = struct.unpack(order + "I", entry[8:12])[0]
            above, below = struct.unpack(order + "II", data[at : at + 8])
            found[tag] = above / below if below else 0.0
    scale = {2: 1.0, 3: 2.54}.get(int(found.get(296, 2)))
    dpi = tuple(found[t] * scale if scale and found.get(t) else None for t in (282, 283))
    return int(found.get(256, 0)), int(found.get(257, 0)), *dpi


def _jpeg(data: bytes) -> Header:
    at, dpi = 2, (None, None)
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE0 and body[:5] == b"JFIF\0":
            unit, x, y = struct.unpack(">BHH", body[7:12])
            if unit in (1, 2) and x and y:
                dpi = (x * (1.0, 2.54)[unit - 1], y * (1.0, 2.54)[unit - 1])
        elif mark == 0xE1 and body[:6] == b"Exif\0\0" and dpi[0] is None:
            dpi = _tiff(body[6:])[2:]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            return width, height, *dpi
        at += 2 + size


def _bmp(data: bytes) -> Header:
    width, height = struct.unpack("<ii", data[18:26])
    x, y = struct.unpack("<ii", data[38:46])
    return width, abs(height), *((x * 0.0254, y * 0.0254) if x > 0 and y > 0 else (None, None))


def header(data: bytes) -> tuple[Header | None, str | None]:
    """Width, height and both resolutions (null: none named) of an image by its first bytes, or an error."""
    read = _png if data[:8] == b"\x89PNG\r\n\x1a\n" else _jpeg if data[:2] == b"\xff\xd8" else _tiff if data[:4] in (b"II*\0", b"MM\0*") else _bmp if data[:2] == b"BM" else None
    if read is None:
        return None, "unknown_format"
    try:
        found = read(data)
    except (struct.error, IndexError):
        return None, "truncated"
    return (found, None) if found[0] > 0 and found[1] > 0 else (None, "no_size")


def _small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold few rows: Spark reads the setting when the plan runs."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def headers(images: DataFrame) -> DataFrame:
    """path, width, height, dpi_x, dpi_y and error of every image (path, content, error): too_large, unknown_format, truncated or no_size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, error in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found, why = header(content.as_py() or b"") if error is None else (None, error)
                w, h, x, y = found or (None,) * 4
                rows.append((w, h, *((x, y) if x and y else (DEFAULT_DPI, DEFAULT_DPI) if found else (None, None)), why))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()), strict=True))], names=["path", "width", "height", "dpi_x", "dpi_y", "error"])

    return images.select("path", "content", "error").mapInArrow(run, "path string, width int, height int, dpi_x double, dpi_y double, error string")


class Engine(Protocol):
    """An OCR engine of a task."""

    def read(self, content: bytes, suffix: str) -> list[dict]:
        """The engine's results by page; the first one counts."""

    def close(self) -> None:
        """Give up what the engine holds."""


def read_images(images: DataFrame, open_engine: Callable[[], Engine]) -> DataFrame:
    """path, raw (JSON as geometry.read_pages takes it) and error of every image (path, suffix, content, error).

    open_engine makes the engine of a task, at its first image. An image that the engine fails on is a row with
    engine_failed and the exception's name; a broken header ends the image before the engine sees it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        try:
            for batch in batches:
                raws, errors = [], []
                for content, suffix, error in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    data = content.as_py() or b""
                    found, why = header(data) if error is None else (None, error)
                    raw = None
                    if found:
                        try:
                            engine = engine or open_engine()
                            pages = engine.read(data, suffix)
                            dpi = list(found[2:]) if found[2] and found[3] else [DEFAULT_DPI, DEFAULT_DPI]
                            raw = json.dumps({"width": found[0], "height": found[1], "dpi": dpi, "page_number": 1, "page": pages[0] if pages else {}})
                        except Exception as failure:  # noqa: BLE001  what an engine raises is the image's error
                            why = f"engine_failed: {type(failure).__name__}"
                    raws.append(raw)
                    errors.append(why)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.string()), pa.array(errors, pa.string())], names=["path", "raw", "error"])
        finally:
            if engine is not None:
                engine.close()

    return _small_batches(images.select("path", "content", "suffix", "error")).mapInArrow(run, "path string, raw string, error string")
