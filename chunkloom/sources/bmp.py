"""Uncompressed 24- and 32-bit BMP files as rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.sources.png import read_files


def parse(content: bytes) -> tuple[int, int, int, bytes] | None:
    """(width, height, channels, rgb or rgba rows from the top), or None if it is not such a file."""
    if len(content) < 54 or content[:2] != b"BM":
        return None
    number = lambda at, n=4: int.from_bytes(content[at : at + n], "little", signed=True)
    offset, width, height, bits, packing = number(10), number(18), number(22), number(28, 2), number(30)
    if width <= 0 or not height or bits not in (24, 32) or packing not in (0, 3):
        return None
    channels, rows = bits // 8, abs(height)
    step = -(-width * channels // 4) * 4
    if offset + step * rows > len(content):
        return None
    grid = np.frombuffer(content, np.uint8, step * rows, offset).reshape(rows, step)[:, : width * channels].reshape(rows, width, channels)
    order = [2, 1, 0, *range(3, channels)]
    return width, rows, channels, (grid[::-1] if height > 0 else grid)[:, :, order].tobytes()


def rasters(files: DataFrame) -> DataFrame:
    """image_id, width, height, bits, color_type, bit_depth, pixels of files (image_id, content); unreadable files give a row of nulls."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(c or b"") for c in batch.column(1).to_pylist()]
            pick = lambda f, t: pa.array([None if x is None else f(x) for x in found], t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pick(lambda x: x[0], pa.int64()), pick(lambda x: x[1], pa.int64()), pick(lambda x: 8 * x[2], pa.int32()), pick(lambda x: 2 if x[2] == 3 else 6, pa.int32()), pick(lambda x: 8, pa.int32()), pick(lambda x: x[3], pa.binary())],
                ["image_id", "width", "height", "bits", "color_type", "bit_depth", "pixels"],
            )

    return files.select("image_id", "content").mapInArrow(work, "image_id long, width long, height long, bits int, color_type int, bit_depth int, pixels binary")


def read_bmp(spark: SparkSession, path: str) -> DataFrame:
    return rasters(read_files(spark, path, "*.bmp"))


def field(raster_rows: DataFrame, name: str) -> DataFrame:
    """One field (width, height, bits or pixels) of each raster."""
    return raster_rows.select("image_id", F.col(name))
