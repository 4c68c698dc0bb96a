"""Pixels of rasters: samples to colors, channel order, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.bytes import byte_values

DISPLAY, SMALL = 600, 100


def pixels(rows: DataFrame) -> DataFrame:
    """image_id, y, x, r, g, b, a (0..255) of rows (image_id, y, row, color_type, bit_depth); 16-bit samples keep their high byte.

    Packed and indexed images give no pixels here: their rows carry the flag unsupported upstream.
    """
    step = (F.col("bit_depth") / 8).cast("int")
    samples = F.expr("CASE color_type WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 6 THEN 4 END")
    able = rows.where(F.col("bit_depth").isin(8, 16) & F.col("color_type").isin(0, 2, 4, 6))
    cut = able.select("image_id", "y", "color_type", step.alias("s"), samples.alias("k"), byte_values(F.col("row")).alias("v"))
    width = F.floor(F.size("v") / (F.col("s") * F.col("k"))).cast("int")
    exploded = cut.where(width > 0).select("*", F.explode(F.sequence(F.lit(0), width - 1)).alias("x"))
    at = lambda j: F.element_at("v", F.col("x") * F.col("s") * F.col("k") + F.lit(j) * F.col("s") + 1)
    grey = F.col("color_type").isin(0, 4)
    return exploded.select(
        "image_id", "y", "x", at(0).alias("r"),
        F.when(grey, at(0)).otherwise(at(1)).alias("g"),
        F.when(grey, at(0)).otherwise(at(2)).alias("b"),
        F.when(F.col("color_type") == 4, at(1)).when(F.col("color_type") == 6, at(3)).otherwise(255).alias("a"),
    )


def swap_red_blue(pixel_rows: DataFrame) -> DataFrame:
    return pixel_rows.withColumns({"r": F.col("b"), "b": F.col("r")})


def upscale(pixel_rows: DataFrame, factor: int | Column) -> DataFrame:
    """Nearest neighbour: each pixel becomes factor x factor pixels."""
    k = factor if isinstance(factor, Column) else F.lit(factor)
    steps = F.sequence(F.lit(0), k - 1)
    wide = pixel_rows.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.withColumns({"x": F.col("x") * k + F.col("_dx"), "y": F.col("y") * k + F.col("_dy")}).drop("_dx", "_dy")


def display_scale(width: Column, height: Column) -> Column:
    """Images under 100 pixels in either direction are enlarged towards 600, others shown as they are."""
    return F.when((width < SMALL) | (height < SMALL), F.greatest(F.floor(F.lit(DISPLAY) / width), F.floor(F.lit(DISPLAY) / height))).otherwise(1).cast("int")
