"""How DEFLATE would see a byte stream: tokens, histograms, codes and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators import lz77, symbols


def prefix_code_report(streams: DataFrame) -> DataFrame:
    """stream_id, block_no, alphabet, value, frequency, level, bits of streams (stream_id, data)."""
    stream = lz77.symbol_stream(lz77.tokens(lz77.blocks(streams)))
    keys = ("stream_id", "block_no", "alphabet")
    histogram = stream.groupBy(*keys, "value").agg(F.count("*").alias("frequency"))
    return symbols.adjacent_prefix_code(histogram, keys)


def coded_sizes(streams: DataFrame) -> DataFrame:
    """stream_id, bits: code bits of all symbols, without extra bits and headers."""
    return prefix_code_report(streams).groupBy("stream_id").agg(F.sum(F.col("frequency") * F.col("level")).alias("bits"))
