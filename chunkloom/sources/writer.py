"""PNG containers from columns, and files from containers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.bytes import be_bytes, crc32, utf8
from chunkloom.sources.png import SIGNATURE

IDAT_BYTES = 16_384
# The comment the writer leaves.
KEYWORD, COMMENT = "Software", "chunkloom"


def signature() -> Column:
    return F.lit(SIGNATURE)


def chunk(tag: str | Column, data: Column) -> Column:
    """Length, tag, payload and CRC-32 as bytes."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(be_bytes(F.octet_length(data), 4), F.encode(name, "US-ASCII"), data, be_bytes(crc32(name, data), 4))


def ihdr(width: Column, height: Column, bit_depth: Column, color_type: Column) -> Column:
    return chunk("IHDR", F.concat(be_bytes(width, 4), be_bytes(height, 4), be_bytes(bit_depth, 1), be_bytes(color_type, 1), F.lit(bytes(3))))


def text(keyword: Column, value: Column) -> Column:
    return chunk("tEXt", F.concat(utf8(keyword), F.lit(bytes(1)), utf8(value)))


def ztxt(keyword: Column, deflated: Column) -> Column:
    """deflated: the text as a zlib stream."""
    return chunk("zTXt", F.concat(utf8(keyword), F.lit(bytes(2)), deflated))


def phys(x: Column, y: Column, unit: Column) -> Column:
    return chunk("pHYs", F.concat(be_bytes(x, 4), be_bytes(y, 4), be_bytes(unit, 1)))


def gama(gamma: Column) -> Column:
    return chunk("gAMA", be_bytes(gamma, 4))


def time(modified: Column) -> Column:
    parts = (F.year(modified), F.month(modified), F.dayofmonth(modified), F.hour(modified), F.minute(modified), F.second(modified))
    return chunk("tIME", F.concat(*[be_bytes(p, 2 if i == 0 else 1) for i, p in enumerate(parts)]))


def _joined(values: Column, size: int) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2 * size, "0")), ""))


def hist(frequencies: Column) -> Column:
    return chunk("hIST", _joined(frequencies, 2))


def plte(entries: Column) -> Column:
    """entries: array of struct(r, g, b)."""
    return chunk("PLTE", _joined(F.flatten(F.transform(entries, lambda e: F.array(e.r, e.g, e.b))), 1))


def sbit(bits: Column) -> Column:
    return chunk("sBIT", _joined(bits, 1))


def bkgd(values: Column, size: int = 2) -> Column:
    """One palette index (size 1), one grey or three color values (size 2)."""
    return chunk("bKGD", _joined(values, size))


def srgb(intent: Column) -> Column:
    return chunk("sRGB", be_bytes(intent, 1))


def chrm(values: Column) -> Column:
    """Eight numbers: white, red, green, blue, each x and y."""
    return chunk("cHRM", _joined(values, 4))


def idat(data: Column, size: int = IDAT_BYTES) -> Column:
    """The data cut into chunks of at most size bytes; one empty chunk for no data."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: chunk("IDAT", F.substring(data, i * size + 1, F.lit(size))))
    return F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p))


def iend() -> Column:
    return chunk("IEND", F.lit(b"").cast("binary"))


def container(width: Column, height: Column, bit_depth: Column, color_type: Column, deflated: Column, *extra: Column) -> Column:
    """A whole file: signature, header, further chunks, image data, end."""
    return F.concat(signature(), ihdr(width, height, bit_depth, color_type), *extra, idat(deflated), iend())


def write_files(images: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each content to folder/name through the file system API of the cluster, so that any store Spark knows will do.

    Returns name and length of the files. Each is written under a task's own name and then renamed, so a task that is run again after
    its executor was lost replaces its files whole.
    """
    from chunkloom.sources.store import put

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n, d in zip(names, data, strict=True):
                put(folder, n, d or b"")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(d or b"") for d in data], pa.int64())], ["name", "length"])

    return images.select(F.col(name), F.col(content)).mapInArrow(work, "name string, length long")
