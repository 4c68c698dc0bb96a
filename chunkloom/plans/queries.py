"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import bytes as by
from chunkloom.functions import dims
from chunkloom.operators import deflate, encoder, filters, lz77, pixels, symbols
from chunkloom.sources import png, writer

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str, rows: int = 16) -> DataFrame:
    """Embeddings as samples: one vector a scanline, rows scanlines an image, bytes from -1..1."""
    v = F.col("v").cast("double")
    byte = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + 1) * 127.5))).cast("int")
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return cells.select(F.floor(F.col("vec_id") / rows).cast("long").alias("image_id"), (F.col("vec_id") % rows).cast("int").alias("y"), "i", byte.alias("x"))


RASTER_SQL = """cells AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT vec_id // 16 AS image_id, CAST(vec_id % 16 AS INT) AS y, CAST(i AS INT) AS i,
              CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS INT) AS x FROM cells),
nb1 AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY image_id, y ORDER BY i), 0) AS a, coalesce(lag(x) OVER (PARTITION BY image_id, i ORDER BY y), 0) AS b FROM px),
nb AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY image_id, y ORDER BY i), 0) AS c FROM nb1)"""
PREDICT_SQL = {
    "none": "0", "sub": "a", "up": "b", "average": "(a + b) // 2",
    "paeth": "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END",
}
FILTERED_SQL = {n: f"(x - ({p}) + 256) % 256" for n, p in PREDICT_SQL.items()}


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.byte_histogram(table(spark, sf_dir, "documents"), "text")


def symbol_frequency_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = byte_histogram(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy(F.desc("frequency"), "value")))  # at most 256 rows
    return ranked.select("place", "value", "frequency")


def byte_histogram_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bytes of documents by language, empty bins included."""
    return symbols.byte_histogram_by(table(spark, sf_dir, "documents"), "text", "lang")


def non_empty_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.non_empty(byte_histogram_by_lang(spark, sf_dir), ("lang",))


def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("value"), F.col("p_partkey").alias("pos"))
    return symbols.first_occurrence(rows)


def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", by.adler32(by.utf8(F.col("text"))).alias("adler"))


def crc32_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", by.crc32(F.lit("tEXt"), by.utf8(F.col("n_name"))).alias("crc"))


def byteswap32(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", by.byteswap32(key).alias("swapped"), by.byteswap16(key).alias("swapped16"))


def dword_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = by.bytes_of_dword(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.element_at(parts, i + 1).alias(f"b{i}") for i in range(4)])


def bit_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", by.bit_reverse(F.col("o_orderkey"), 15).alias("reversed"))


def integer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    bracket = by.log2_bracket(size)
    return table(spark, sf_dir, "part").select(
        "p_partkey", by.align_up(F.col("p_partkey"), 16).alias("aligned"), by.power_of_two(size % 30).alias("power"), bracket.below.alias("below"), bracket.above.alias("above"), F.octet_length("p_name").alias("name_bytes")
    )


def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("event_type") == "click", "tEXt").when(F.col("event_type") == "view", "IDAT").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", dims.tag_id(tag).alias("tag_id"))


def length_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (F.col("l_partkey") % 256 + 3).cast("int")
    code = dims.length_code(length)
    return table(spark, sf_dir, "lineitem").groupBy(length.alias("length"), code.code.alias("code"), code.extra_bits.alias("extra_bits"), code.extra.alias("extra")).agg(F.count("*").alias("n"))


def distance_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = (F.col("l_orderkey") % 32768 + 1).cast("int")
    code = dims.distance_code(distance)
    return table(spark, sf_dir, "lineitem").groupBy(code.code.alias("code"), code.extra_bits.alias("extra_bits")).agg(F.count("*").alias("n"), F.min(distance).alias("least"), F.max(distance).alias("most"), F.sum(code.extra).alias("extra_sum"))


def code_value_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256 + 3).cast("int").alias("length"), (F.col("p_partkey") * 7919 % 32768 + 1).cast("int").alias("distance"))
    lc, dc = dims.length_code(F.col("length")), dims.distance_code(F.col("distance"))
    return keys.select("p_partkey", dims.length_of(lc.code, lc.extra).alias("length"), dims.distance_of(dc.code, dc.extra).alias("distance"))


def _forward(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.forward(raster(spark, sf_dir), name)

    return query


def _unfilter(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.unfilter_samples(filters.forward(raster(spark, sf_dir), name), name)

    return query


def filter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.scores(raster(spark, sf_dir)).drop("w")


def filter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.chosen_filters(raster(spark, sf_dir))


def fixed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.canonical_codes(dims.fixed_lengths(spark), ("alphabet",))


def _size_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length 1..15 for each size and brand: one alphabet a brand."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("sym")).agg((F.count("*") % 11 + 5).cast("int").alias("len"))


def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.canonical_codes(_size_lengths(spark, sf_dir), ("brand",))


def code_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _size_lengths(spark, sf_dir)
    return symbols.code_length_histogram(lengths, ("brand",)).join(symbols.longest_code(lengths, ("brand",)), "brand")


def _row_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths with long runs: line numbers of a stretch of orders, one alphabet for 100 orders."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 300).alias("key"), (F.col("l_orderkey") % 300).cast("int").alias("sym"))
    return rows.agg(F.when(F.count("*") % 3 == 0, F.count("*") % 7).otherwise(0).cast("int").alias("len"))


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.runs(_row_lengths(spark, sf_dir), ("key",))


def run_length_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = symbols.run_length_symbols(run_lengths(spark, sf_dir), ("key",))
    return coded.groupBy("symbol", "extra_bits").agg(F.count("*").alias("n"), F.sum("times").alias("covered"))


def run_length_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places count from 0 in each alphabet, as absent symbols leave no gap here."""
    lengths = _row_lengths(spark, sf_dir).withColumn("sym", (F.row_number().over(Window.partitionBy("key").orderBy("sym")) - 1).cast("int"))
    return symbols.expand_run_lengths(symbols.run_length_symbols(symbols.runs(lengths, ("key",)), ("key",)), ("key",))


def block_32k(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), by.utf8(F.col("text")).alias("data"))
    return lz77.blocks(streams).select("stream_id", "block_no", F.octet_length("data").alias("size"))


def _name_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's priorities and statuses in a row: short streams that repeat themselves."""
    text = F.concat(F.repeat(F.concat("o_orderpriority", "o_orderstatus"), 3), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stream_id"), by.utf8(text).alias("data"))


def lz77_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = lz77.expand_tokens(lz77.tokens(lz77.blocks(_name_streams(spark, sf_dir))))
    return back.select(F.col("stream_id").alias("o_orderkey"), F.decode("data", "UTF-8").alias("text"))


def lz77_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), by.utf8(F.col("text")).alias("data"))
    return lz77.with_codes(lz77.tokens(lz77.blocks(streams)))


def lz77_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the tokens of each turn stand for."""
    return lz77_tokens(spark, sf_dir).groupBy("stream_id").agg(F.sum(F.coalesce("len", F.lit(1))).alias("bytes"))


def adjacent_prefix_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.adjacent_prefix_code(byte_histogram(spark, sf_dir))


def adjacent_kraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = symbols.adjacent_prefix_code(byte_histogram_by_lang(spark, sf_dir), ("lang",)).withColumnRenamed("level", "len")
    return symbols.kraft_sum(codes, ("lang",))


def encoded_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed codes of the letters of names, as bits and bytes."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.posexplode(by.byte_values(by.utf8(F.col("n_name")))).alias("pos", "value"))
    codes = symbols.canonical_codes(dims.fixed_lengths(spark).where("alphabet = 'litlen'")).select(F.col("sym").alias("value"), F.lpad(F.bin("code"), F.col("len"), F.lit("0")).alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "bits")))
    text = names.join(F.broadcast(codes), "value").groupBy("k").agg(F.array_join(F.transform(ordered, lambda x: x.bits), "").alias("bits"))  # 288 codes
    return text.select(F.col("k").alias("n_nationkey"), "bits", F.hex(symbols.pack_bits(F.col("bits"))).alias("packed"))


def _conversation_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container of a text chunk for each turn of a conversation."""
    turn = writer.text(F.col("role"), F.col("text"))
    parts = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("c")))).alias("parts"))
    body = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p.c))
    return parts.select("image_id", F.concat(writer.signature(), body, writer.iend()).alias("content"))


def chunk_pack_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = png.texts(png.chunks(_conversation_images(spark, sf_dir)))
    return rows.select(F.col("image_id").alias("conv_id"), F.col("seq").cast("long").alias("place"), F.col("keyword").alias("role"), "text")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png.counts(png.chunks(_conversation_images(spark, sf_dir))).withColumnRenamed("image_id", "conv_id")


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = png.chunks(_conversation_images(spark, sf_dir))
    return rows.groupBy("type", "type_id", "crc_ok", "truncated").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def idat_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("seq"), F.lit("IDAT").alias("type"), by.utf8(F.col("text")).alias("data"))
    return png.image_data(rows).select(F.col("image_id").alias("conv_id"), F.decode("idat", "UTF-8").alias("text"))


def text_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.concat(by.utf8(F.col("role")), F.lit(bytes(1)), by.utf8(F.col("text")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", data.alias("data"))
    return rows.select("conv_id", "turn", by.c_string(F.col("data")).alias("role"), F.decode(by.after_nul(F.col("data")), "UTF-8").alias("text"))


def time_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), F.concat(writer.signature(), writer.time(F.col("ts")), writer.iend()).alias("content"))
    rows = png.time(png.chunks(events))
    return rows.select(F.col("image_id").alias("event_id"), "year", "month", "day", "hour", "minute", "second")


def number_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pHYs, gAMA and sRGB records made from parts and read back."""
    body = F.concat(writer.signature(), writer.phys(F.col("p_partkey"), F.col("p_partkey") * 2, F.lit(1)), writer.gama(F.col("p_partkey") + 45455), writer.srgb(F.col("p_size") % 6), writer.iend())
    rows = png.chunks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), body.alias("content")))
    joined = png.phys(rows).select("image_id", "x", "y", "unit").join(png.gama(rows).select("image_id", "gamma"), "image_id").join(png.srgb(rows).select("image_id", "intent", "label"), "image_id")
    return joined.withColumnRenamed("image_id", "p_partkey")


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of containers made from orders, with what follows from them."""
    color = F.element_at(F.array(*[F.lit(c) for c in (0, 2, 3, 4, 6)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    depth = F.element_at(F.array(*[F.lit(d) for d in (4, 8, 16)]), (F.col("o_custkey") % 3 + 1).cast("int"))
    content = F.concat(writer.signature(), writer.ihdr(F.col("o_orderkey") + 1, F.col("o_custkey") + 1, depth, color), writer.iend())
    rows = png.ihdr(png.chunks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), content.alias("content"))))
    return rows.select(F.col("image_id").alias("o_orderkey"), "width", "height", "bit_depth", "color_type", "bpp", "stride", "unsupported")


def inflate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", by.utf8(F.col("html")).alias("data"))
    back = deflate.inflate(deflate.deflate(pages, "data", "z").select("page_id", "z"), "z", "raw")
    return back.select("page_id", F.decode("raw", "UTF-8").alias("html"))


def inflate_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block rows of deflated part names: tokens decoded bit by bit, expanded, and compared with the names."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("stream_id"), by.utf8(F.repeat("n_name", 5)).alias("data"))
    streams = deflate.deflate(names, "data", "z").select("stream_id", F.col("z").alias("data"))
    text = lz77.expand_tokens(deflate.inflate_tokens(streams), chained=True).select("stream_id", F.decode("data", "UTF-8").alias("text"))
    return text.select(F.col("stream_id").cast("int").alias("n_nationkey"), "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), by.utf8(F.col("text")).alias("data"))


def deflate_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through the encoder of this package, and back through zlib, which also tests their Adler-32."""
    back = deflate.inflate(encoder.encode_streams(_turns(spark, sf_dir)), "data", "raw")
    return back.select("stream_id", F.decode("raw", "UTF-8").alias("text"), F.col("raw_error").alias("error"))


def deflate_own_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through the encoder, decoded bit by bit: dynamic blocks, their tokens expanded. A null turn is an empty stream, as in the SQL."""
    turns = _turns(spark, sf_dir).withColumn("data", F.coalesce("data", F.lit(b"")))
    back = deflate.inflate_streams(encoder.encode_streams(turns))
    return back.select("stream_id", "blocks", "least_type", "most_type", "final", F.nullif(F.decode("data", "UTF-8"), F.lit("")).alias("text"))


def inflate_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in stored blocks, decoded bit by bit."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("stream_id"), by.utf8(F.col("p_name")).alias("data"))
    streams = deflate.deflate(names, "data", "z", level=0).select("stream_id", F.col("z").alias("data"))
    text = lz77.expand_tokens(deflate.inflate_tokens(streams), chained=True).select(F.col("stream_id").alias("p_partkey"), F.decode("data", "UTF-8").alias("text"))
    return text.join(deflate.inflate_blocks(streams).select(F.col("stream_id").alias("p_partkey"), "type", "n_tokens"), "p_partkey")


def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols of a stream are literals and how many are length codes."""
    symbol = F.col("l_partkey") % 300
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", dims.is_literal(symbol).alias("literal"), dims.is_length_code(symbol).alias("length"))
    return rows.groupBy("l_suppkey").agg(F.count_if("literal").alias("literals"), F.count_if("length").alias("length_codes"))


def _listed(values: F.Column) -> F.Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def color_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cHRM, hIST, sBIT and bKGD records made from parts and read back, a row each."""
    key, size = F.col("p_partkey"), F.col("p_size")
    content = F.concat(
        writer.signature(), writer.ihdr(key, size, F.lit(8), F.lit(2)), writer.chrm(F.array(*[key + k for k in range(8)])), writer.sbit(F.array(size % 8, size % 7, size % 6)),
        writer.hist(F.array(size, key % 65536)), writer.bkgd(F.array(size, key % 65536, F.lit(3))), writer.iend(),
    )
    rows = png.chunks(table(spark, sf_dir, "part").select(key.alias("image_id"), content.alias("content")))
    chrm = F.array(*[f"{c}_{axis}" for c in ("white", "red", "green", "blue") for axis in "xy"])
    kinds = (("cHRM", png.chrm(rows), chrm), ("hIST", png.hist(rows), F.col("frequencies")), ("sBIT", png.sbit(rows), F.col("bits")), ("bKGD", png.bkgd(rows), F.array("red", "green", "blue")))
    parts = [df.select(F.col("image_id").alias("p_partkey"), F.lit(kind).alias("kind"), _listed(values).alias("numbers")) for kind, df, values in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def palette_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of as many entries as a part's size, read back entry by entry."""
    entry = lambda i: F.struct((F.col("p_partkey") % 256).alias("r"), i.alias("g"), (F.col("p_size") + i).alias("b"))
    content = F.concat(writer.signature(), writer.plte(F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), entry)), writer.iend())
    rows = png.palette(png.chunks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), content.alias("content"))))
    return rows.select(F.col("image_id").alias("p_partkey"), "entry", "r", "g", "b")


def packed_text_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as zTXt records, which the package's own encoder packed, and an unknown chunk that is left alone."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("stream_id"), by.utf8(F.col("html")).alias("data"))
    body = F.concat(writer.signature(), writer.chunk("quQu", F.unhex(F.lit("00"))), writer.ztxt(F.lit("Page"), F.col("data")), writer.iend())
    rows = png.texts(png.chunks(encoder.encode_streams(pages).select(F.col("stream_id").alias("image_id"), body.alias("content"))))
    return rows.select(F.col("image_id").alias("page_id"), "keyword", "text", "compressed", F.col("seq").cast("long").alias("place"))


def unknown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(writer.signature(), writer.chunk("quQu", by.utf8(F.col("n_name"))), writer.iend())
    rows = png.undefined(png.chunks(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("image_id"), content.alias("content"))))
    return rows.select(F.col("image_id").alias("n_nationkey"), "type", F.col("length").cast("long").alias("length"), "crc_ok", F.decode("data", "UTF-8").alias("name"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples a pixel; the last one of a row is filled up with zeros."""
    cells = raster(spark, sf_dir)
    sample = lambda k: F.coalesce(F.max(F.when(F.col("i") % 3 == k, F.col("x"))), F.lit(0))
    wide = cells.groupBy("image_id", "y", F.floor(F.col("i") / 3).cast("int").alias("x")).agg(*[sample(k).alias(c) for k, c in enumerate("rgb")])
    return wide.withColumn("a", F.lit(255))


def rgb_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.swap_red_blue(_pixels(spark, sf_dir))


def upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.upscale(_pixels(spark, sf_dir), 2)


def display_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 5, (F.col("p_partkey") % 400 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", pixels.display_scale(w, h).alias("scale"))


def bytes_per_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    color, depth = F.col("p_size") % 8, F.element_at(F.array(*[F.lit(d) for d in (1, 2, 4, 8, 16)]), (F.col("p_partkey") % 5 + 1).cast("int"))
    keys = table(spark, sf_dir, "part").select(color.alias("color_type"), depth.alias("bit_depth")).distinct()
    return keys.withColumn("bpp", dims.bytes_per_pixel(F.col("color_type"), F.col("bit_depth")))


def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters filtered, deflated, put into containers, taken apart and decoded again."""
    from chunkloom.plans.decode import decode

    samples = raster(spark, sf_dir)
    lines = filters.filter_raster(samples)
    line = F.concat(F.unhex(F.lpad(F.hex("filter"), 2, "0")), F.col("row"))
    rows = lines.groupBy("image_id").agg(F.count("*").alias("height"), F.array_sort(F.collect_list(F.struct("y", line.alias("l")))).alias("lines"))
    raw = rows.select("image_id", "height", F.unhex(F.array_join(F.transform("lines", lambda s: F.hex(s.l)), "")).alias("raw"))
    done = deflate.deflate(raw, "raw", "idat")
    images = done.select("image_id", writer.container(F.lit(64), F.col("height"), F.lit(8), F.lit(0), F.col("idat")).alias("content"))
    return decode(images).select("image_id", "y", F.col("x").alias("i"), F.col("r").alias("x"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        byte_histogram, symbol_frequency_sort, byte_histogram_by_lang, non_empty_bins, first_occurrence, adler32, crc32_names, byteswap32, dword_bytes, bit_reverse,
        integer_functions, tag_lookup, length_code, distance_code, code_value_roundtrip, filter_scores, filter_choice, fixed_codes, canonical_codes, code_length_histogram,
        run_lengths, run_length_symbols, run_length_roundtrip, block_32k, lz77_roundtrip, lz77_tokens, lz77_coverage, adjacent_prefix_code, adjacent_kraft, encoded_bits, chunk_pack_parse,
        chunk_counts, chunk_report, idat_concat, text_record, time_record, number_records, image_headers, inflate_roundtrip, inflate_walk, rgb_swap, upscale, display_scale,
        bytes_per_pixel, image_roundtrip, deflate_own, deflate_own_walk, inflate_stored, symbol_kinds, color_records, palette_record, packed_text_record, unknown_chunks,
    )
}
for _name in filters.NAMES[1:]:
    QUERIES[f"filter_{_name}"] = _forward(_name)
    QUERIES[f"unfilter_{_name}"] = _unfilter(_name)


def _band_sql(value: str, bands: list[tuple[int, int, int]], pick: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {b[1]} THEN {b[pick] if pick != 1 else f'{value} - {b[1]}'}" for b in reversed(bands)) + " END"


def _tag_sql(tag: str) -> str:
    return f"CASE {tag} " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(dims.TAGS)) + f" ELSE {dims.UNDEFINED_TAG} END"


CRC_SQL = """crc_table AS (SELECT list(c ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k)))"""
_SIZES = "sizes AS (SELECT p_brand AS brand, p_size AS sym, CAST(count(*) % 11 + 5 AS INT) AS len FROM part GROUP BY ALL)"
_ROWS = "rows_ AS (SELECT l_orderkey // 300 AS key, CAST(l_orderkey % 300 AS INT) AS sym, CAST(CASE WHEN count(*) % 3 = 0 THEN count(*) % 7 ELSE 0 END AS INT) AS len FROM lineitem GROUP BY ALL)"
_RUNS = f"""{_ROWS}, isl AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sym) - row_number() OVER (PARTITION BY key, len ORDER BY sym) AS g FROM rows_),
runs AS (SELECT key, len, min(sym) AS start, count(*) AS n FROM isl GROUP BY key, len, g)"""
_BYTES = "SELECT ('0x' || p)::INT AS value FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS p FROM documents)"
_LANGS = "langs AS (SELECT DISTINCT lang FROM documents WHERE octet_length(encode(text)) > 0)"
_BINS = f"""{_LANGS}, bins AS (SELECT lang, CAST(unnest(range(256)) AS INT) AS value FROM langs),
f AS (SELECT lang, ('0x' || p)::INT AS value, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS p FROM documents) GROUP BY ALL),
h AS (SELECT b.lang, b.value, coalesce(f.n, 0) AS frequency FROM bins b LEFT JOIN f ON f.lang IS NOT DISTINCT FROM b.lang AND f.value = b.value)"""
_PIXELS = f"WITH {RASTER_SQL}, p AS (SELECT image_id, y, CAST(i // 3 AS INT) AS x, max(x) FILTER (i % 3 = 0) AS r, coalesce(max(x) FILTER (i % 3 = 1), 0) AS g, coalesce(max(x) FILTER (i % 3 = 2), 0) AS b, 255 AS a FROM px GROUP BY image_id, y, i // 3)"
_LEN = "CAST(l_partkey % 256 + 3 AS INT)"
_DIST = "CAST(l_orderkey % 32768 + 1 AS INT)"
_FIXED_LEN = "CASE WHEN s < 144 THEN 8 WHEN s < 256 THEN 9 WHEN s < 280 THEN 7 ELSE 8 END"

ORACLES: dict[str, str] = {
    "byte_histogram": f"SELECT value, count(*) AS frequency FROM ({_BYTES}) GROUP BY value",
    "symbol_frequency_sort": f"SELECT CAST(row_number() OVER (ORDER BY frequency DESC, value) AS INT) AS place, value, frequency FROM (SELECT value, count(*) AS frequency FROM ({_BYTES}) GROUP BY value)",
    "byte_histogram_by_lang": f"WITH {_BINS} SELECT * FROM h",
    "non_empty_bins": f"WITH {_BINS} SELECT lang, count(*) FILTER (frequency > 0) AS non_empty FROM h GROUP BY lang",
    "first_occurrence": "SELECT p_size AS value, min(p_partkey) AS first_pos FROM part GROUP BY p_size",
    "adler32": """WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT) AS v FROM documents),
s AS (SELECT doc_id, len(v) AS n, coalesce(list_sum(v), 0)::BIGINT AS a, coalesce(list_sum(list_transform(v, lambda x, i: (len(v) - i + 1) * x)), 0)::BIGINT AS w FROM b)
SELECT doc_id, (n + w) % 65521 * 65536 + (1 + a) % 65521 AS adler FROM s""",
    "crc32_names": f"""WITH {CRC_SQL}, b AS (SELECT n_name, list_transform(regexp_extract_all(hex(encode('tEXt' || n_name)), '..'), lambda p: ('0x' || p)::BIGINT) AS v FROM nation)
SELECT n_name, xor(list_reduce(list_prepend(4294967295::BIGINT, v), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM b, crc_table""",
    "byteswap32": """SELECT o_orderkey, ((o_orderkey & 255) << 24) + (((o_orderkey >> 8) & 255) << 16) + (((o_orderkey >> 16) & 255) << 8) + ((o_orderkey >> 24) & 255) AS swapped,
((o_orderkey & 255) << 8) + ((o_orderkey >> 8) & 255) AS swapped16 FROM orders""",
    "dword_bytes": "SELECT o_orderkey, " + ", ".join(f"CAST((o_orderkey >> {8 * i}) & 255 AS INT) AS b{i}" for i in range(4)) + " FROM orders",
    "bit_reverse": "SELECT o_orderkey, CAST(" + " + ".join(f"(((o_orderkey >> {i}) & 1) << {14 - i})" for i in range(15)) + " AS BIGINT) AS reversed FROM orders",
    "integer_functions": """SELECT p_partkey, (p_partkey + 15) // 16 * 16 AS aligned, 1::BIGINT << (p_size % 30) AS power, 1::BIGINT << CAST(floor(log2(p_size)) AS INT) AS below,
1::BIGINT << CAST(ceil(log2(p_size)) AS INT) AS above, CAST(octet_length(encode(p_name)) AS INT) AS name_bytes FROM part""",
    "tag_lookup": f"SELECT event_id, {_tag_sql('''(CASE event_type WHEN 'click' THEN 'tEXt' WHEN 'view' THEN 'IDAT' ELSE event_type END)''')} AS tag_id FROM events",
    "length_code": f"SELECT length, {_band_sql('length', dims.length_bands(), 0)} AS code, {_band_sql('length', dims.length_bands(), 2)} AS extra_bits, {_band_sql('length', dims.length_bands(), 1)} AS extra, count(*) AS n FROM (SELECT {_LEN} AS length FROM lineitem) GROUP BY ALL",
    "distance_code": f"""SELECT code, extra_bits, count(*) AS n, min(d) AS least, max(d) AS most, CAST(sum(extra) AS BIGINT) AS extra_sum FROM
(SELECT d, {_band_sql('d', dims.distance_bands(), 0)} AS code, {_band_sql('d', dims.distance_bands(), 2)} AS extra_bits, {_band_sql('d', dims.distance_bands(), 1)} AS extra FROM (SELECT {_DIST} AS d FROM lineitem)) GROUP BY code, extra_bits""",
    "code_value_roundtrip": "SELECT p_partkey, CAST(p_partkey % 256 + 3 AS INT) AS length, CAST(p_partkey * 7919 % 32768 + 1 AS INT) AS distance FROM part",
    "filter_scores": f"WITH {RASTER_SQL} SELECT image_id, y, " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS s_{n}" for n, e in FILTERED_SQL.items()) + " FROM nb GROUP BY image_id, y",
    "filter_choice": f"""WITH {RASTER_SQL}, s AS (SELECT image_id, y, [{', '.join(f'sum({e})' for e in FILTERED_SQL.values())}] AS s FROM nb GROUP BY image_id, y)
SELECT image_id, y, CAST(CASE WHEN y > 0 THEN list_position(s, list_min(s)) - 1 ELSE 0 END AS INT) AS filter FROM s""",
    "fixed_codes": f"""WITH l AS (SELECT 'litlen' AS alphabet, CAST(s AS INT) AS sym, {_FIXED_LEN} AS len FROM range(288) t(s) UNION ALL SELECT 'dist', CAST(s AS INT), 5 FROM range(30) t(s))
SELECT s1.alphabet, s1.sym, s1.len, CAST(coalesce(sum(1 << (15 - s2.len)) FILTER (s2.len < s1.len OR (s2.len = s1.len AND s2.sym < s1.sym)), 0) AS BIGINT) >> (15 - s1.len) AS code
FROM l s1 JOIN l s2 USING (alphabet) GROUP BY s1.alphabet, s1.sym, s1.len""",
    "canonical_codes": f"""WITH {_SIZES}
SELECT s1.brand, s1.sym, s1.len, CAST(coalesce(sum(1 << (15 - s2.len)) FILTER (s2.len < s1.len OR (s2.len = s1.len AND s2.sym < s1.sym)), 0) AS BIGINT) >> (15 - s1.len) AS code
FROM sizes s1 JOIN sizes s2 USING (brand) GROUP BY s1.brand, s1.sym, s1.len""",
    "code_length_histogram": f"WITH {_SIZES} SELECT brand, len, count(*) AS n, max_len FROM sizes JOIN (SELECT brand, max(len) AS max_len FROM sizes GROUP BY brand) USING (brand) GROUP BY ALL",
    "run_lengths": f"WITH {_RUNS} SELECT key, len, start, n FROM runs",
    "run_length_symbols": f"""WITH {_RUNS}, parts AS (
SELECT 18 AS symbol, 7 AS extra_bits, n // 138 AS k, n // 138 * 138 AS c FROM runs WHERE len = 0
UNION ALL SELECT 18, 7, 1, n % 138 FROM runs WHERE len = 0 AND n % 138 >= 11
UNION ALL SELECT 17, 3, 1, n % 138 FROM runs WHERE len = 0 AND n % 138 BETWEEN 3 AND 10
UNION ALL SELECT 0, 0, n % 138, n % 138 FROM runs WHERE len = 0 AND n % 138 < 3
UNION ALL SELECT len, 0, 1, 1 FROM runs WHERE len > 0
UNION ALL SELECT 16, 2, (n - 1) // 6, (n - 1) // 6 * 6 FROM runs WHERE len > 0
UNION ALL SELECT 16, 2, 1, (n - 1) % 6 FROM runs WHERE len > 0 AND (n - 1) % 6 >= 3
UNION ALL SELECT len, 0, (n - 1) % 6, (n - 1) % 6 FROM runs WHERE len > 0 AND (n - 1) % 6 < 3)
SELECT symbol, extra_bits, CAST(sum(k) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS covered FROM parts WHERE k > 0 GROUP BY ALL""",
    "run_length_roundtrip": f"WITH {_ROWS} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY sym) - 1 AS INT) AS sym, len FROM rows_",
    "block_32k": """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) > 0),
b AS (SELECT doc_id, n, unnest(range((n + 32767) // 32768)) AS block_no FROM d)
SELECT doc_id AS stream_id, CAST(block_no AS INT) AS block_no, CAST(least(32768, n - block_no * 32768) AS INT) AS size FROM b""",
    "lz77_roundtrip": "SELECT o_orderkey, repeat(o_orderpriority || o_orderstatus, 3) || CAST(o_custkey AS VARCHAR) AS text FROM orders",
    "lz77_coverage": "SELECT conv_id * 1000 + turn AS stream_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM conversations WHERE octet_length(encode(text)) > 0 GROUP BY ALL",
    "encoded_bits": f"""WITH v AS (SELECT n_nationkey, regexp_extract_all(hex(encode(n_name)), '..') AS v FROM nation),
c AS (SELECT n_nationkey, generate_subscripts(v, 1) AS i, 48 + ('0x' || unnest(v))::INT AS c FROM v)
SELECT n_nationkey, string_agg(lpad(bin(c), 8, '0'), '' ORDER BY i) AS bits, string_agg(printf('%02X', {' + '.join(f'(((c >> {k}) & 1) << {7 - k})' for k in range(8))}), '' ORDER BY i) AS packed FROM c GROUP BY n_nationkey""",
    "adjacent_kraft": f"WITH {_LANGS} SELECT lang, CAST(1.0 AS DOUBLE) AS kraft FROM langs",
    "chunk_pack_parse": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, text FROM conversations",
    "chunk_counts": "SELECT conv_id, 0::BIGINT AS idat, count(*) AS text, 0::BIGINT AS ztxt, count(*) + 1 AS chunks FROM conversations GROUP BY conv_id",
    "chunk_report": """SELECT 'tEXt' AS type, 9 AS type_id, true AS crc_ok, false AS truncated, count(*) AS n, CAST(sum(octet_length(encode(role)) + 1 + octet_length(encode(text))) AS BIGINT) AS bytes FROM conversations
UNION ALL SELECT 'IEND', 13, true, false, count(DISTINCT conv_id), 0 FROM conversations""",
    "idat_concat": "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "text_record": "SELECT conv_id, turn, role, text FROM conversations",
    "time_record": "SELECT event_id, " + ", ".join(f"CAST(date_part('{p}', ts) AS INT) AS {p}" for p in ("year", "month", "day", "hour", "minute", "second")) + " FROM events",
    "number_records": """SELECT p_partkey, p_partkey AS x, p_partkey * 2 AS y, 1 AS unit, p_partkey + 45455 AS gamma, p_size % 6 AS intent,
CASE p_size % 6 """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.INTENTS.items()) + " ELSE 'error' END AS label FROM part",
    "image_headers": """WITH h AS (SELECT o_orderkey, o_orderkey + 1 AS width, o_custkey + 1 AS height, [4, 8, 16][o_custkey % 3 + 1] AS bit_depth, [0, 2, 3, 4, 6][o_orderkey % 5 + 1] AS color_type FROM orders),
s AS (SELECT *, [1, 3, 1, 2, 4][o_orderkey % 5 + 1] AS k FROM h)
SELECT o_orderkey, width, height, bit_depth, color_type, CASE WHEN bit_depth < 8 OR color_type = 3 THEN 0 ELSE k * bit_depth // 8 END AS bpp, (width * k * bit_depth + 7) // 8 AS stride, bit_depth < 8 OR color_type = 3 AS unsupported FROM s""",
    "inflate_roundtrip": "SELECT page_id, html FROM pages",
    "inflate_walk": "SELECT n_nationkey, repeat(n_name, 5) AS text FROM nation",
    "rgb_swap": f"{_PIXELS} SELECT image_id, y, x, b AS r, g, r AS b, a FROM p",
    "upscale": f"{_PIXELS}, d AS (SELECT unnest([0, 1]) AS d) SELECT image_id, y * 2 + v.d AS y, x * 2 + h.d AS x, r, g, b, a FROM p, d h, d v",
    "display_scale": "WITH s AS (SELECT p_partkey, p_size * 5 AS w, p_partkey % 400 + 1 AS h FROM part) SELECT p_partkey, CAST(CASE WHEN w < 100 OR h < 100 THEN greatest(600 // w, 600 // h) ELSE 1 END AS INT) AS scale FROM s",
    "bytes_per_pixel": """WITH k AS (SELECT DISTINCT p_size % 8 AS color_type, [1, 2, 4, 8, 16][p_partkey % 5 + 1] AS bit_depth FROM part),
s AS (SELECT *, CASE color_type WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 4 END AS n FROM k)
SELECT color_type, bit_depth, CASE WHEN n IS NULL THEN NULL WHEN bit_depth < 8 OR color_type = 3 THEN 0 ELSE n * bit_depth // 8 END AS bpp FROM s""",
    "deflate_own": "SELECT conv_id * 1000 + turn AS stream_id, text, CAST(NULL AS VARCHAR) AS error FROM conversations",
    "deflate_own_walk": """SELECT conv_id * 1000 + turn AS stream_id, greatest(1, (octet_length(encode(text)) + 32767) // 32768)::BIGINT AS blocks, 2 AS least_type, 2 AS most_type, true AS final,
nullif(text, '') AS text FROM conversations""",
    "inflate_stored": "SELECT p_partkey, p_name AS text, 0 AS type, CAST(octet_length(encode(p_name)) AS INT) AS n_tokens FROM part",
    "symbol_kinds": "SELECT l_suppkey, count(*) FILTER (l_partkey % 300 < 256) AS literals, count(*) FILTER (l_partkey % 300 BETWEEN 257 AND 285) AS length_codes FROM lineitem GROUP BY l_suppkey",
    "color_records": """SELECT p_partkey, 'cHRM' AS kind, array_to_string(list_transform(range(8), lambda k: p_partkey + k), ',') AS numbers FROM part
UNION ALL SELECT p_partkey, 'hIST', concat_ws(',', p_size, p_partkey % 65536) FROM part UNION ALL SELECT p_partkey, 'sBIT', concat_ws(',', p_size % 8, p_size % 7, p_size % 6) FROM part
UNION ALL SELECT p_partkey, 'bKGD', concat_ws(',', p_size, p_partkey % 65536, 3) FROM part""",
    "palette_record": """SELECT p_partkey, CAST(i - 1 AS INT) AS entry, CAST(p_partkey % 256 AS INT) AS r, CAST(i AS INT) AS g, CAST(p_size + i AS INT) AS b
FROM (SELECT p_partkey, p_size, unnest(range(1, p_size + 1)) AS i FROM part)""",
    "packed_text_record": "SELECT page_id, 'Page' AS keyword, html AS text, true AS compressed, 1::BIGINT AS place FROM pages",
    "unknown_chunks": "SELECT n_nationkey, 'quQu' AS type, octet_length(encode(n_name)) AS length, true AS crc_ok, n_name AS name FROM nation",
    "image_roundtrip": f"WITH {RASTER_SQL} SELECT image_id, y, i, x FROM px",
}
for _name in filters.NAMES[1:]:
    ORACLES[f"filter_{_name}"] = f"WITH {RASTER_SQL} SELECT image_id, y, i, CAST({FILTERED_SQL[_name]} AS INT) AS f FROM nb"
    ORACLES[f"unfilter_{_name}"] = f"WITH {RASTER_SQL} SELECT image_id, y, i, x FROM px"
