"""Rasters to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.bytes import byte_values
from chunkloom.functions.dims import bytes_per_pixel
from chunkloom.operators.deflate import deflate
from chunkloom.operators.filters import filter_raster
from chunkloom.sources import writer


def samples(rasters: DataFrame) -> DataFrame:
    """image_id, y, i, x of rasters (image_id, height, pixels)."""
    stride = (F.octet_length("pixels") / F.col("height")).cast("int")
    rows = rasters.where("pixels IS NOT NULL AND height > 0").select("image_id", stride.alias("stride"), F.posexplode(byte_values(F.col("pixels"))).alias("p", "x"))
    return rows.select("image_id", F.floor(F.col("p") / F.col("stride")).cast("int").alias("y"), (F.col("p") % F.col("stride")).alias("i"), "x")


def encode(rasters: DataFrame, bpp: int = 3, level: int = 6) -> DataFrame:
    """image_id, content of rasters (image_id, width, height, bit_depth, color_type, pixels) whose pixels have bpp bytes.

    Filters are chosen by row, then deflated: the stages are those that the analysis tables show one by one.
    """
    able = rasters.where(bytes_per_pixel(F.col("color_type"), F.col("bit_depth")) == bpp)
    line = F.concat(F.unhex(F.lpad(F.hex("filter"), 2, "0")), F.col("row"))
    rows = filter_raster(samples(able), bpp).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", line.alias("l")))).alias("lines"))
    raw = rows.select("image_id", F.unhex(F.array_join(F.transform("lines", lambda s: F.hex(s.l)), "")).alias("raw"))
    done = deflate(raw, "raw", "idat", level).select("image_id", "idat")
    joined = able.select("image_id", "width", "height", "bit_depth", "color_type").join(done, "image_id")
    comment = writer.text(F.lit(writer.KEYWORD), F.lit(writer.COMMENT))
    return joined.select("image_id", writer.container(F.col("width"), F.col("height"), F.col("bit_depth"), F.col("color_type"), F.col("idat"), comment).alias("content"))
