"""Scanline filters, forward and back, and the choice among them.

A raster is a table of samples (image_id, y, i, x): byte i of row y. Forward filters are neighbours in windows; so are the inverses of sub and
up, which are running sums. The inverses of average and paeth are recurrences in both directions and run once for each image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.bytes import paeth

NAMES = ("none", "sub", "up", "average", "paeth")
#: Rows narrower than this keep their first row as it is; wider ones filter it by sub.
NARROW = 600


def neighbours(samples: DataFrame, bpp: int) -> DataFrame:
    """Adds a (left), b (above) and c (above left), 0 outside the image.

    One shuffle, by image: it serves both windows and what groups by image and row afterwards.
    """
    samples = samples.repartition("image_id")
    row = Window.partitionBy("image_id", "y").orderBy("i")
    column = Window.partitionBy("image_id", "i").orderBy("y")
    zero = F.lit(0)
    above = samples.withColumn("b", F.coalesce(F.lag("x").over(column), zero))
    return above.withColumns({"a": F.coalesce(F.lag("x", bpp).over(row), zero), "c": F.coalesce(F.lag("b", bpp).over(row), zero)})


def predicted(name: str, a: Column, b: Column, c: Column) -> Column:
    return {"none": F.lit(0), "sub": a, "up": b, "average": F.floor((a + b) / 2), "paeth": paeth(a, b, c)}[name]


def forward(samples: DataFrame, name: str, bpp: int = 1) -> DataFrame:
    """image_id, y, i, f: filtered bytes."""
    rows = neighbours(samples, bpp) if name != "none" else samples.withColumns({k: F.lit(0) for k in "abc"})
    value = F.pmod(F.col("x") - predicted(name, F.col("a"), F.col("b"), F.col("c")), F.lit(256)).cast("int")
    return rows.select("image_id", "y", "i", value.alias("f"))


def scores(samples: DataFrame, bpp: int = 1) -> DataFrame:
    """image_id, y, s_none .. s_paeth (sums of the unsigned bytes each filter emits), w (bytes of the row). One pass over the neighbours for all five."""
    value = lambda name: F.pmod(F.col("x") - predicted(name, F.col("a"), F.col("b"), F.col("c")), F.lit(256))
    return neighbours(samples, bpp).groupBy("image_id", "y").agg(*[F.sum(value(n)).cast("long").alias(f"s_{n}") for n in NAMES], F.count("*").alias("w"))


def choice(score_rows: DataFrame) -> DataFrame:
    """Adds filter: the least score, the first of equal ones."""
    all_scores = F.array(*[F.col(f"s_{n}") for n in NAMES])
    return score_rows.withColumn("filter", (F.array_position(all_scores, F.array_min(all_scores)) - 1).cast("int"))


def chosen_filters(samples: DataFrame, bpp: int = 1, narrow: int = NARROW) -> DataFrame:
    """image_id, y, filter: none or sub for the first row by its width, else by score."""
    picked = choice(scores(samples, bpp))
    return picked.select("image_id", "y", F.when(F.col("y") > 0, F.col("filter")).when(F.col("w") < narrow, 0).otherwise(1).alias("filter"))


def filter_raster(samples: DataFrame, bpp: int = 1, narrow: int = NARROW) -> DataFrame:
    """image_id, y, filter, row (binary): scanlines by the chosen filter of each row."""
    rows = neighbours(samples, bpp).join(chosen_filters(samples, bpp, narrow), ["image_id", "y"])
    value = F.lit(None).cast("int")
    for k, name in enumerate(NAMES):
        value = F.when(F.col("filter") == k, F.pmod(F.col("x") - predicted(name, F.col("a"), F.col("b"), F.col("c")), F.lit(256)).cast("int")).otherwise(value)
    ordered = F.array_sort(F.collect_list(F.struct("i", F.lpad(F.hex(value), 2, "0").alias("h"))))
    return rows.groupBy("image_id", "y", "filter").agg(F.unhex(F.array_join(F.transform(ordered, lambda s: s.h), "")).alias("row"))


def unfilter_sub(filtered: DataFrame, bpp: int = 1) -> DataFrame:
    """Running sum along the row, for each byte of a pixel by itself."""
    window = Window.partitionBy("image_id", "y", F.col("i") % bpp).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return filtered.select("image_id", "y", "i", F.pmod(F.sum("f").over(window), F.lit(256)).cast("int").alias("x"))


def unfilter_up(filtered: DataFrame) -> DataFrame:
    """Running sum down the column."""
    window = Window.partitionBy("image_id", "i").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return filtered.select("image_id", "y", "i", F.pmod(F.sum("f").over(window), F.lit(256)).cast("int").alias("x"))


def undo_row(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """A row's bytes before filtering. none, sub and up on whole arrays; average and paeth byte by byte in plain integers."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        pad = -len(line) % bpp
        return np.add.accumulate(np.append(line, np.zeros(pad, np.uint8)).reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[: len(line)]
    out, up, raw = [0] * bpp, [0] * bpp + above.tolist(), line.tolist()
    if kind == 3:
        for i, f in enumerate(raw):
            out.append((f + (out[i] + up[i + bpp]) // 2) & 255)
    elif kind == 4:
        for i, f in enumerate(raw):
            a, b, c = out[i], up[i + bpp], up[i]
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out.append((f + (a if da <= db and da <= dc else b if db <= dc else c)) & 255)
    else:
        raise ValueError(f"no filter {kind}")
    return np.array(out[bpp:], np.uint8)


def undo_image(lines: list[tuple[int, bytes]], bpp: int) -> list[bytes | None]:
    """Rows without their filters; null from the first row on whose filter does not exist, since each row needs the one above."""
    above, out = None, []
    for kind, raw in lines:
        if not 0 <= kind < len(NAMES):
            return out + [None] * (len(lines) - len(out))
        line = np.frombuffer(raw, np.uint8)
        above = undo_row(kind, line, np.zeros(len(line), np.uint8) if above is None else above, bpp)
        out.append(above.tobytes())
    return out


def unfilter_scanlines(lines: DataFrame, bpp: str = "bpp", keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, y, row, keep: rows of scanlines (image_id, y, filter, row, bpp) without their filters; row is null where a filter is unknown.

    One task works on one image at a time.
    """
    chosen = lines.select("image_id", "y", "filter", "row", F.col(bpp).alias("bpp"), *keep)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("y")
        plain = undo_image(list(zip(rows["filter"], rows["row"], strict=True)), max(1, int(rows["bpp"].iloc[0])))
        return pd.DataFrame({"image_id": rows["image_id"], "y": rows["y"], "row": plain, **{k: rows[k] for k in keep}})

    return chosen.groupBy("image_id").applyInPandas(work, chosen.select("image_id", "y", "row", *keep).schema)


def unfilter_samples(filtered: DataFrame, name: str, bpp: int = 1) -> DataFrame:
    """The inverse of forward() for one filter: image_id, y, i, x."""
    if name == "none":
        return filtered.withColumnRenamed("f", "x")
    if name == "sub":
        return unfilter_sub(filtered, bpp)
    if name == "up":
        return unfilter_up(filtered)
    kind = NAMES.index(name)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "i"])
        width = int((rows["y"] == rows["y"].iloc[0]).sum())
        grid = rows["f"].to_numpy(np.uint8).reshape(-1, width)
        plain = undo_image([(kind, line.tobytes()) for line in grid], bpp)
        return rows[["image_id", "y", "i"]].assign(x=np.frombuffer(b"".join(plain), np.uint8).astype(np.int32))

    return filtered.groupBy("image_id").applyInPandas(work, filtered.select("image_id", "y", "i", F.col("f").cast("int").alias("x")).schema)


def split_scanlines(raws: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """image_id, y, filter, row, bpp, keep (ints) of raws (image_id, raw, stride, bpp): a filter byte, then stride bytes, a row; a torn last row is left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, raw, stride, bpp, *kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(raw) // (stride + 1) if raw and stride else 0
                if n:
                    at = [y * (stride + 1) for y in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([raw[k] for k in at], pa.int32()), pa.array([raw[k + 1 : k + 1 + stride] for k in at], pa.binary()), pa.array([bpp] * n, pa.int32()), *(pa.array([k] * n, pa.int32()) for k in kept)],
                        ["image_id", "y", "filter", "row", "bpp", *keep],
                    )

    ints = "".join(f", {k} int" for k in keep)
    return raws.select("image_id", "raw", "stride", "bpp", *keep).mapInArrow(work, f"image_id long, y int, filter int, row binary, bpp int{ints}")
