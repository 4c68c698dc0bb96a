"""Fixed dimension tables of the PNG and DEFLATE formats, as small DataFrames; longer ones are built from rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Chunk tags and their numbers; 14 stands for any other.
TAGS = ("IHDR", "IDAT", "PLTE", "sRGB", "bKGD", "cHRM", "gAMA", "sBIT", "zTXt", "tEXt", "tIME", "pHYs", "hIST", "IEND")
UNDEFINED_TAG = 14
# Color types with their samples for each pixel.
COLOR_TYPES = {0: ("grey", 1), 2: ("rgb", 3), 3: ("indexed", 1), 4: ("grey_alpha", 2), 6: ("rgba", 4)}
# Scanline filters, DEFLATE block types, rendering intents.
FILTERS = {0: "none", 1: "sub", 2: "up", 3: "average", 4: "paeth"}
BLOCK_TYPES = {0: "stored", 1: "fixed", 2: "dynamic", 3: "error"}
INTENTS = {0: "perceptual", 1: "relative colorimetric", 2: "saturation", 3: "absolute colorimetric"}
# Fixed value: the order in which code lengths of the code-length alphabet are stored.
CODE_LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)

MAX_MATCH, MAX_DISTANCE = 258, 32768


def length_bands() -> list[tuple[int, int, int]]:
    """(code, base, extra bits) of match lengths: groups of four codes, one more bit each; 258 has a code of its own."""
    out, base = [], 3
    for i in range(28):
        bits = max(0, i // 4 - 1)
        out.append((257 + i, base, bits))
        base += 1 << bits
    return [*out, (285, MAX_MATCH, 0)]


def distance_bands() -> list[tuple[int, int, int]]:
    """(code, base, extra bits) of distances: groups of two codes, one more bit each."""
    out, base = [], 1
    for i in range(30):
        bits = max(0, i // 2 - 1)
        out.append((i, base, bits))
        base += 1 << bits
    return out


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(TAGS)], "tag string, tag_id int")


def tag_id(tag: Column) -> Column:
    """Number of a chunk tag, UNDEFINED_TAG if unknown: a CASE over 14 constants, so no join is planned."""
    out = F.lit(UNDEFINED_TAG)
    for i, t in enumerate(TAGS):
        out = F.when(tag == t, i).otherwise(out)
    return out


def _dense(spark: SparkSession, bands: list[tuple[int, int, int]], most: int, name: str) -> DataFrame:
    rows = [(base + k, code, base, bits, k) for code, base, bits in bands for k in range(1 << bits) if base + k <= most]
    if name == "length":  # 258 is both the last of band 284 and code 285: the latter counts
        rows = [r for r in rows if not (r[0] == MAX_MATCH and r[1] != 285)]
    return spark.createDataFrame(rows, f"{name} int, code int, base int, extra_bits int, extra int")


def length_codes(spark: SparkSession) -> DataFrame:
    """One row for each match length 3..258: an equi-join key."""
    return _dense(spark, length_bands(), MAX_MATCH, "length")


def _band_code(value: Column, bands: list[tuple[int, int, int]]) -> Column:
    out = F.struct(F.lit(None).cast("int").alias("code"), F.lit(None).cast("int").alias("extra_bits"), F.lit(None).cast("int").alias("extra"))
    for code, base, bits in bands:
        out = F.when(value >= base, F.struct(F.lit(code).alias("code"), F.lit(bits).alias("extra_bits"), (value - base).cast("int").alias("extra"))).otherwise(out)
    return out


def length_code(length: Column) -> Column:
    """struct(code, extra_bits, extra) of a match length, null outside 3..258. Sorted bands in one CASE need no join."""
    return F.when(length.between(3, MAX_MATCH), _band_code(length, length_bands()))


def distance_code(distance: Column) -> Column:
    return F.when(distance.between(1, MAX_DISTANCE), _band_code(distance, distance_bands()))


def _band_value(code: Column, extra: Column, bands: list[tuple[int, int, int]]) -> Column:
    out = F.lit(None).cast("int")
    for c, base, _ in bands:
        out = F.when(code == c, F.lit(base)).otherwise(out)
    return (out + extra).cast("int")


def length_of(code: Column, extra: Column) -> Column:
    return _band_value(code, extra, length_bands())


def distance_of(code: Column, extra: Column) -> Column:
    """Null for the codes 30 and 31, which the format leaves out."""
    return _band_value(code, extra, distance_bands())


def fixed_lengths(spark: SparkSession) -> DataFrame:
    """sym, len, alphabet of the fixed prefix codes."""
    sym = spark.range(288).select(F.col("id").cast("int").alias("sym"))
    literal = sym.select(F.lit("litlen").alias("alphabet"), "sym", F.when(F.col("sym") < 144, 8).when(F.col("sym") < 256, 9).when(F.col("sym") < 280, 7).otherwise(8).alias("len"))
    return literal.unionByName(spark.range(30).select(F.lit("dist").alias("alphabet"), F.col("id").cast("int").alias("sym"), F.lit(5).alias("len")))


def samples_per_pixel(color_type: Column) -> Column:
    out = F.lit(None).cast("int")
    for c, (_, n) in COLOR_TYPES.items():
        out = F.when(color_type == c, n).otherwise(out)
    return out


def bytes_per_pixel(color_type: Column, bit_depth: Column) -> Column:
    """Whole bytes of a pixel; 0 where pixels are packed or indexed, null for an unknown color type."""
    whole = (samples_per_pixel(color_type) * bit_depth / 8).cast("int")
    return F.when(samples_per_pixel(color_type).isNull(), F.lit(None).cast("int")).when((bit_depth < 8) | (color_type == 3), 0).otherwise(whole)


def is_literal(symbol: Column) -> Column:
    return symbol.between(0, 255)


def is_length_code(symbol: Column) -> Column:
    return symbol.between(257, 285)
