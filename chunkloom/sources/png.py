"""PNG containers: files to chunk rows, chunk rows to typed records and image data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.bytes import after_nul, be_uint, c_string, crc32, hex_pairs, hex_to_long
from chunkloom.functions.dims import INTENTS, TAGS, bytes_per_pixel, samples_per_pixel, tag_id

# Fixed value: the eight bytes every file starts with.
SIGNATURE = bytes((0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A))
CHUNK = "image_id long, seq int, offset long, type string, length long, data binary, crc long, truncated boolean"


def read_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """image_id, path, length, content; without content selected, files are listed but not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "length", "content")


def file_sizes(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    return read_files(spark, path, pattern).select("image_id", "path", "length")


def split_chunks(content: bytes) -> list[tuple[int, int, str, int, bytes, int | None, bool]]:
    """(seq, offset, type, length, data, crc, truncated) up to the end chunk or the end of the bytes.

    Bytes that end without an end chunk, also just after another chunk or within the signature, give a last row marked truncated.
    """
    out, at = [], len(SIGNATURE)
    while at + 8 <= len(content):
        length = int.from_bytes(content[at : at + 4], "big")
        tag = content[at + 4 : at + 8].decode("latin-1")
        end = at + 8 + length
        data = content[at + 8 : end]
        crc = int.from_bytes(content[end : end + 4], "big") if end + 4 <= len(content) else None
        out.append((len(out), at, tag, length, data, crc, crc is None))
        if tag == "IEND" or crc is None:
            return out
        at = end + 4
    out.append((len(out), min(at, len(content)), "", 0, content[at:], None, True))
    return out


def chunks(images: DataFrame) -> DataFrame:
    """Chunk rows of images (image_id, content), with type_id, crc_ok and signature_ok. Bytes that end early give a row marked truncated."""
    names = [f.split()[0] for f in CHUNK.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = split_chunks(content or b"")
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                good = [(content or b"")[:8] == SIGNATURE] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(rows), pa.int64()), *columns, pa.array(good, pa.bool_())], [*names, "signature_ok"])

    rows = images.select(F.col("image_id").cast("long"), "content").mapInArrow(work, f"{CHUNK}, signature_ok boolean")
    return rows.withColumns({"type_id": tag_id(F.col("type")), "crc_ok": F.coalesce(F.col("crc") == crc32(F.col("type"), F.col("data")), F.lit(False))})


def report(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.select("image_id", "seq", "type_id", "type").orderBy("image_id", "seq")


def counts(chunk_rows: DataFrame) -> DataFrame:
    """Chunks, and those of the kinds that may repeat, of each image."""
    n = lambda t: F.count_if(F.col("type") == t)
    return chunk_rows.groupBy("image_id").agg(n("IDAT").alias("idat"), n("tEXt").alias("text"), n("zTXt").alias("ztxt"), F.count("*").alias("chunks"))


def _of(chunk_rows: DataFrame, tag: str) -> DataFrame:
    return chunk_rows.where(F.col("type") == tag)


def _columns(layout: list[tuple[str, int]]) -> list[F.Column]:
    columns, at = [], 1
    for name, size in layout:
        value = be_uint(F.col("data"), at, size)
        columns.append((value if size == 4 else value.cast("int")).alias(name))
        at += size
    return columns


def _fields(chunk_rows: DataFrame, tag: str, layout: list[tuple[str, int]]) -> DataFrame:
    return _of(chunk_rows, tag).select("image_id", "seq", *_columns(layout))


IHDR = [("width", 4), ("height", 4), ("bit_depth", 1), ("color_type", 1), ("compression", 1), ("filter", 1), ("interlace", 1)]


def image_parts(images: DataFrame) -> DataFrame:
    """image_id, the fields of the header, and idat (joined payloads) of images (image_id, content): one pass for what decoding needs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, data = [], []
            for content in batch.column(1).to_pylist():
                rows = split_chunks(content or b"")
                heads.append(next((r[4] for r in rows if r[2] == "IHDR"), None))
                data.append(b"".join(r[4] for r in rows if r[2] == "IDAT"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary()), pa.array(data, pa.binary())], ["image_id", "data", "idat"])

    parts = images.select(F.col("image_id").cast("long"), "content").mapInArrow(work, "image_id long, data binary, idat binary")
    return _with_geometry(parts.select("image_id", *_columns(IHDR), "idat"))


def ihdr(chunk_rows: DataFrame) -> DataFrame:
    """Headers with bpp, stride and unsupported (interlaced, indexed, packed or unknown)."""
    return _with_geometry(_fields(chunk_rows, "IHDR", IHDR))


def _with_geometry(head: DataFrame) -> DataFrame:
    samples = samples_per_pixel(F.col("color_type"))
    bits = F.col("width") * samples * F.col("bit_depth")
    return head.withColumns(
        {
            "bpp": bytes_per_pixel(F.col("color_type"), F.col("bit_depth")),
            "stride": F.floor((bits + 7) / 8).cast("long"),
            "unsupported": (F.col("interlace") != 0) | (F.col("color_type") == 3) | (F.col("bit_depth") < 8) | samples.isNull(),
        }
    )


def srgb(chunk_rows: DataFrame) -> DataFrame:
    label = F.lit("error")
    for code, name in INTENTS.items():
        label = F.when(F.col("intent") == code, name).otherwise(label)
    return _fields(chunk_rows, "sRGB", [("intent", 1)]).withColumn("label", label)


def gama(chunk_rows: DataFrame) -> DataFrame:
    return _fields(chunk_rows, "gAMA", [("gamma", 4)])


def chrm(chunk_rows: DataFrame) -> DataFrame:
    return _fields(chunk_rows, "cHRM", [(f"{c}_{axis}", 4) for c in ("white", "red", "green", "blue") for axis in "xy"])


def phys(chunk_rows: DataFrame) -> DataFrame:
    return _fields(chunk_rows, "pHYs", [("x", 4), ("y", 4), ("unit", 1)])


def time(chunk_rows: DataFrame) -> DataFrame:
    parts = _fields(chunk_rows, "tIME", [("year", 2), ("month", 1), ("day", 1), ("hour", 1), ("minute", 1), ("second", 1)])
    return parts.withColumn("modified", F.expr("try_make_timestamp(year, month, day, hour, minute, least(second, 59))"))


def palette(chunk_rows: DataFrame) -> DataFrame:
    """All entries, not only the first."""
    triples = F.regexp_extract_all(F.hex("data"), F.lit("(.{6})"), F.lit(1))
    part = lambda t, k: hex_to_long(F.substring(t, F.lit(2 * k + 1), F.lit(2))).cast("int")
    return _of(chunk_rows, "PLTE").select("image_id", "seq", F.posexplode(triples).alias("entry", "t")).select("image_id", "seq", "entry", part(F.col("t"), 0).alias("r"), part(F.col("t"), 1).alias("g"), part(F.col("t"), 2).alias("b"))


def _shorts(data: F.Column) -> F.Column:
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(.{4})"), F.lit(1)), lambda h: hex_to_long(h).cast("int"))


def hist(chunk_rows: DataFrame) -> DataFrame:
    return _of(chunk_rows, "hIST").select("image_id", "seq", _shorts(F.col("data")).alias("frequencies"))


def sbit(chunk_rows: DataFrame) -> DataFrame:
    return _of(chunk_rows, "sBIT").select("image_id", "seq", F.transform(hex_pairs(F.col("data")), lambda h: hex_to_long(h).cast("int")).alias("bits"))


def bkgd(chunk_rows: DataFrame) -> DataFrame:
    """palette_index, grey, or red, green and blue, by the color type of the image's header."""
    head = ihdr(chunk_rows).select("image_id", "color_type")
    rows = _of(chunk_rows, "bKGD").join(head, "image_id")
    kind, data = F.col("color_type"), F.col("data")
    grey, rgb = kind.isin(0, 4), kind.isin(2, 6)
    short = lambda p: be_uint(data, p, 2).cast("int")
    return rows.select("image_id", "seq", F.when(kind == 3, be_uint(data, 1, 1).cast("int")).alias("palette_index"), F.when(grey, short(1)).alias("grey"), F.when(rgb, short(1)).alias("red"), F.when(rgb, short(3)).alias("green"), F.when(rgb, short(5)).alias("blue"))


def trns(chunk_rows: DataFrame) -> DataFrame:
    """Transparency values: one byte an entry for indexed images, shorts otherwise."""
    head = ihdr(chunk_rows).select("image_id", "color_type")
    rows = _of(chunk_rows, "tRNS").join(head, "image_id")
    single = F.transform(hex_pairs(F.col("data")), lambda h: hex_to_long(h).cast("int"))
    return rows.select("image_id", "seq", F.when(F.col("color_type") == 3, single).otherwise(_shorts(F.col("data"))).alias("values"))


def texts(chunk_rows: DataFrame) -> DataFrame:
    """image_id, seq, keyword, text, compressed, error of tEXt and zTXt chunks."""
    from chunkloom.operators.deflate import inflate

    plain = _of(chunk_rows, "tEXt").select("image_id", "seq", c_string(F.col("data")).alias("keyword"), F.decode(after_nul(F.col("data")), "UTF-8").alias("text"), F.lit(False).alias("compressed"), F.lit(None).cast("string").alias("error"))
    rest = after_nul(F.col("data"))
    packed = _of(chunk_rows, "zTXt").select("image_id", "seq", c_string(F.col("data")).alias("keyword"), F.substring(rest, F.lit(2), F.octet_length(rest)).alias("z"))
    packed = inflate(packed, "z", "t").select("image_id", "seq", "keyword", F.decode("t", "UTF-8").alias("text"), F.lit(True).alias("compressed"), F.col("t_error").alias("error"))
    return plain.unionByName(packed)


def undefined(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.where(~F.col("type").isin(*TAGS))


def image_data(chunk_rows: DataFrame) -> DataFrame:
    """image_id, idat: the payloads of an image's IDAT chunks in order, any number of them."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "data")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p.data))
    return _of(chunk_rows, "IDAT").groupBy("image_id").agg(joined.alias("idat"))
