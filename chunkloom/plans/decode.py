"""Files to pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators import pixels as px
from chunkloom.operators.deflate import inflate
from chunkloom.operators.filters import split_scanlines, unfilter_scanlines
from chunkloom.sources import png


def decode(images: DataFrame) -> DataFrame:
    """image_id, y, x, r, g, b, a of images (image_id, content). Unsupported or damaged images give no pixels: see image_status.

    Rows from an unknown filter on give none either. Files are parsed once; the only shuffle brings the scanlines of an image together.
    """
    kept = ("color_type", "bit_depth")
    able = png.image_parts(images).where("NOT unsupported").select("image_id", "idat", "stride", "bpp", *kept)
    raw = inflate(able, "idat", "raw").where("raw IS NOT NULL")
    return px.pixels(unfilter_scanlines(split_scanlines(raw, kept), keep=kept).where("row IS NOT NULL"))


def show(images: DataFrame) -> DataFrame:
    """Pixels as they are shown: enlarged if the image is small."""
    size = png.ihdr(png.chunks(images)).select("image_id", px.display_scale(F.col("width"), F.col("height")).alias("k"))
    return px.upscale(decode(images).join(size, "image_id"), F.col("k")).drop("k")


def image_status(images: DataFrame) -> DataFrame:
    """image_id, width, height, truncated, crc_ok, adler_ok, unsupported, error of every image."""
    from chunkloom.operators.deflate import adler_ok

    chunk_rows = png.chunks(images)
    whole = chunk_rows.groupBy("image_id").agg(F.max("truncated").alias("truncated"), F.min("crc_ok").alias("crc_ok"))
    head = png.ihdr(chunk_rows).select("image_id", "width", "height", "unsupported")
    data = adler_ok(inflate(png.image_data(chunk_rows), "idat", "raw"), "idat", "raw").select("image_id", "adler_ok", F.col("raw_error").alias("error"))
    return images.select("image_id").join(head, "image_id", "left").join(whole, "image_id", "left").join(data, "image_id", "left")
