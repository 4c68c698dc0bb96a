"""Image files as a stream: an extension, for folders that fill up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.sources import png


def stream_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """image_id, path, length, content of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "length", "content")


def stream_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of files as they arrive; without state, so nothing grows with the stream."""
    return png.chunks(stream_files(spark, path))
