"""Known answers, round trips and error cases of the image and byte-stream operators."""

import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import bytes as by
from chunkloom.functions import dims
from chunkloom.operators import deflate, encoder, filters, lz77, pixels, symbols
from chunkloom.plans import analysis, queries
from chunkloom.plans.decode import decode, image_status, show
from chunkloom.plans.encode import encode
from chunkloom.sources import bmp, png, writer

V30 = b"0" + b"1" * 9 + b"2" + b"1" + b"6" * 18


def chunk(tag, data):
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


def filtered(rows, kinds, bpp):
    """Plain-Python forward filters, for tests only."""
    out, above = b"", bytes(len(rows[0]))
    for row, k in zip(rows, kinds, strict=True):
        line = bytearray()
        for i, x in enumerate(row):
            a, b, c = (row[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, best)[k]) & 255)
        out, above = out + bytes([k]) + bytes(line), row
    return out


def make_png(width, height, color, depth, level=6, pieces=1, extra=(), seed=1, interlace=0):
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    stride, bpp = -(-width * samples * depth // 8), max(1, samples * depth // 8)
    random.seed(seed)
    rows = [bytes(random.choice((7, 7, 90, random.randrange(256))) for _ in range(stride)) for _ in range(height)]
    z = zlib.compress(filtered(rows, [y % 5 if y else seed % 5 for y in range(height)], bpp), level)
    step = -(-len(z) // pieces)
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)) + b"".join(extra)
    body += b"".join(chunk(b"IDAT", z[i : i + step]) for i in range(0, len(z), step))
    return png.SIGNATURE + body + chunk(b"IEND", b""), rows


def images(spark, contents):
    return spark.createDataFrame(list(enumerate(contents)), "image_id long, content binary")


def test_tokens_of_the_known_vector():
    assert lz77.block_tokens(V30) == [
        *[(i, V30[i], None, None) for i in range(6)], (6, None, 4, 5), *[(i, V30[i], None, None) for i in range(10, 17)], (17, None, 4, 5), (21, None, 8, 9), (29, 54, None, None),
    ]


def test_code_report_of_the_known_vector(spark):
    rows = analysis.prefix_code_report(spark.createDataFrame([(1, V30)], "stream_id long, data binary")).where("alphabet = 'litlen' AND value <> 256").collect()
    got = sorted((r.frequency, r.value) for r in rows)
    assert got == sorted([(6, 49), (6, 54), (2, 258), (1, 48), (1, 50), (1, 262)])
    assert symbols.adjacent_levels([6, 6, 2, 1, 1, 1]) == [1, 2, 3, 4, 5, 5]
    assert symbols.ordered_codes([1, 2, 3, 4, 5, 5]) == ["0", "10", "110", "1110", "11110", "11111"]


def test_adjacent_levels():
    assert symbols.adjacent_levels([19, 19, 6, 5, 2, 2, 2, 1]) == [1, 2, 4, 4, 5, 5, 5, 5]
    assert symbols.adjacent_levels([10, 9, 9, 9, 8, 8, 1]) == [2, 3, 4, 4, 2, 3, 3]
    assert symbols.adjacent_levels([]) == [] and symbols.adjacent_levels([5]) == [1] and symbols.adjacent_levels([5, 1]) == [1, 1]
    assert symbols.adjacent_levels([3, 2, 1]) == [1, 2, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=40))
def test_adjacent_code_is_full_and_prefix_free(weights):
    codes = symbols.ordered_codes(symbols.adjacent_levels(sorted(weights, reverse=True)))
    assert sum(2.0 ** -len(c) for c in codes) == 1
    assert not any(a != b and b.startswith(a) for a in codes for b in codes) and len(set(codes)) == len(codes)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400) | st.lists(st.sampled_from([b"ab", b"abc", b"x"]), max_size=150).map(b"".join))
def test_tokens_expand_to_the_data(data):
    found = lz77.block_tokens(data)
    assert lz77.expand([t[1:] for t in found]) == data
    for pos, lit, length, dist in found:
        if length:
            assert pos >= lz77.UNREADY and lz77.LEAST_MATCH <= length <= dims.MAX_MATCH and dist > length
            # no longer string stands earlier
            limit = min(dims.MAX_MATCH, len(data) - pos, pos - 1)
            assert length == limit or data.find(data[pos : pos + length + 1], 0, pos - 1) < 0


def test_expand_overlaps_and_refuses():
    assert lz77.expand([(65, None, None), (None, 7, 1)]) == b"A" * 8
    assert lz77.expand([(None, 3, 2)], b"xy") == b"xyx"
    with pytest.raises(ValueError):
        lz77.expand([(None, 3, 5)])


@pytest.mark.parametrize("level,strategy", [(0, 0), (6, 0), (6, zlib.Z_FIXED), (9, zlib.Z_HUFFMAN_ONLY)])
def test_walk_reads_every_block_type(level, strategy):
    random.seed(level)
    data = bytes(random.choice(b"aabbbcde") for _ in range(70_000))
    c = zlib.compressobj(level, zlib.DEFLATED, 15, 8, strategy)
    stream = c.compress(data) + c.flush()
    parts = list(deflate.walk(stream))
    assert lz77.expand([t for p in parts for t in p[3]]) == data
    assert {p[2] for p in parts} <= {0, 1, 2} and parts[-1][1] and [p[0] for p in parts] == list(range(len(parts)))


def test_damaged_streams_give_error_rows(spark):
    good = zlib.compress(b"hello hello hello")
    df = spark.createDataFrame([(1, good), (2, good[:-6]), (3, b"\x78\x9c\x07"), (4, b""), (5, None)], "stream_id long, data binary")
    rows = {r.stream_id: r for r in deflate.inflate(df, "data", "raw").collect()}
    assert bytes(rows[1].raw) == b"hello hello hello" and rows[2].raw is None and rows[2].raw_error and rows[5].raw is None
    blocks = {r.stream_id: r for r in deflate.inflate_blocks(df).collect()}
    assert blocks[1].error is None and blocks[1].final and blocks[3].type == 3 and blocks[4].error
    assert {r.stream_id for r in deflate.inflate_tokens(df).select("stream_id").distinct().collect()} >= {1}


@pytest.mark.parametrize("lengths,codes", [([3, 3, 3, 3, 3, 2, 4, 4], ["010", "011", "100", "101", "110", "00", "1110", "1111"])])
def test_canonical_codes_of_the_format(spark, lengths, codes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "sym int, len int")
    assert [format(r.code, f"0{r.len}b") for r in symbols.canonical_codes(df).orderBy("sym").collect()] == codes
    assert [symbols.kraft_sum(symbols.canonical_codes(df)).first().kraft] == [1.0]


def test_dense_codes(spark):
    rows = dims.length_codes(spark).collect()
    assert sorted(r.length for r in rows) == list(range(3, 259)) and {r.length: r.code for r in rows}[258] == 285
    assert sum(1 << b[2] for b in dims.distance_bands()) == dims.MAX_DISTANCE
    assert dims.distance_bands()[-1] == (29, 24577, 13) and dims.length_bands()[-2] == (284, 227, 5)


def test_checksums(spark):
    df = spark.createDataFrame([(b"",), (b"abc" * 1000,), (bytes(range(256)) * 40,)], "d binary")
    for r in df.select("d", by.adler32(F.col("d")).alias("a"), by.adler32_closed(F.col("d")).alias("k"), by.crc32(F.lit("IEND"), F.col("d")).alias("c")).collect():
        assert r.a == r.k == zlib.adler32(bytes(r.d)) and r.c == zlib.crc32(b"IEND" + bytes(r.d))


def test_bytes_and_strings(spark):
    df = spark.createDataFrame([(bytearray(b"key\0value"), 0x01020304)], "d binary, n long")
    r = df.select(by.c_string(F.col("d")).alias("k"), F.decode(by.after_nul(F.col("d")), "UTF-8").alias("v"), by.byteswap32(F.col("n")).alias("s"), by.be_bytes(F.col("n"), 4).alias("b"), by.le_bytes(F.col("n"), 4).alias("l"), by.bit_reverse(F.lit(6), 4).alias("r"), by.be_uint(F.col("d"), 8, 4).alias("short")).first()
    assert (r.k, r.v, r.s, bytes(r.b), bytes(r.l), r.r, r.short) == ("key", "value", 0x04030201, b"\1\2\3\4", b"\4\3\2\1", 6, None)


@pytest.mark.parametrize("color", [0, 2, 4, 6])
@pytest.mark.parametrize("depth", [8, 16])
def test_decode_matches_plain_python(spark, color, depth):
    content, rows = make_png(7, 6, color, depth, pieces=3, seed=color + depth)
    samples, step = {0: 1, 2: 3, 4: 2, 6: 4}[color], depth // 8
    got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in decode(images(spark, [content])).collect()}
    for y, row in enumerate(rows):
        for x in range(7):
            v = [row[(x * samples + k) * step] for k in range(samples)]
            assert got[y, x] == {0: lambda: (v[0], v[0], v[0], 255), 2: lambda: (*v, 255), 4: lambda: (v[0], v[0], v[0], v[1]), 6: lambda: tuple(v)}[color]()


def test_many_idat_chunks_and_small_display(spark):
    content, _ = make_png(60, 60, 0, 8, level=0, pieces=305)
    rows = png.chunks(images(spark, [content]))
    assert png.counts(rows).first().idat > 255 and decode(images(spark, [content])).count() == 3600
    assert show(images(spark, [make_png(3, 2, 2, 8)[0]])).count() == 3 * 2 * 300 * 300


def test_records(spark):
    extra = [
        chunk(b"PLTE", bytes(range(9))), chunk(b"sRGB", b"\2"), chunk(b"gAMA", struct.pack(">I", 45455)), chunk(b"cHRM", struct.pack(">8I", *range(8))), chunk(b"pHYs", struct.pack(">IIB", 5, 6, 1)),
        chunk(b"hIST", struct.pack(">3H", 1, 2, 65535)), chunk(b"sBIT", b"\5\6\5"), chunk(b"tEXt", b"Title\0A text"), chunk(b"zTXt", b"Note\0\0" + zlib.compress(b"packed")), chunk(b"zTXt", b"Bad\0\0xx"),
        chunk(b"tIME", struct.pack(">H5B", 2024, 2, 29, 12, 30, 60)), chunk(b"bKGD", struct.pack(">3H", 1, 2, 3)), chunk(b"tRNS", struct.pack(">3H", 4, 5, 6)), chunk(b"quQu", b"?"),
    ]
    rows = png.chunks(images(spark, [make_png(4, 4, 2, 8, extra=extra)[0]])).cache()
    one = lambda df: df.first().asDict()
    assert rows.where("NOT crc_ok OR truncated OR NOT signature_ok").count() == 0
    assert [(r.entry, r.r, r.g, r.b) for r in png.palette(rows).orderBy("entry").collect()] == [(0, 0, 1, 2), (1, 3, 4, 5), (2, 6, 7, 8)]
    assert one(png.srgb(rows))["label"] == "saturation" and one(png.gama(rows))["gamma"] == 45455 and one(png.chrm(rows))["blue_y"] == 7
    assert one(png.phys(rows))["y"] == 6 and one(png.hist(rows))["frequencies"] == [1, 2, 65535] and one(png.sbit(rows))["bits"] == [5, 6, 5]
    assert one(png.bkgd(rows))["blue"] == 3 and one(png.trns(rows))["values"] == [4, 5, 6] and one(png.time(rows))["second"] == 60
    assert [(r.keyword, r.text, r.compressed) for r in png.texts(rows).orderBy("seq").collect()] == [("Title", "A text", False), ("Note", "packed", True), ("Bad", None, True)]
    assert [r.type for r in png.undefined(rows).orderBy("seq").collect()] == ["tRNS", "quQu"]
    head = one(png.ihdr(rows))
    assert (head["width"], head["bpp"], head["stride"], head["unsupported"]) == (4, 3, 12, False)
    rows.unpersist()


def test_damaged_and_unsupported_images(spark):
    good = make_png(5, 5, 0, 8)[0]
    bad_crc = good[:20] + bytes([good[20] ^ 1]) + good[21:]
    packed, indexed, laced = make_png(9, 3, 0, 4)[0], make_png(5, 3, 3, 8)[0], make_png(5, 5, 0, 8, interlace=1)[0]
    df = images(spark, [good, good[:60], bad_crc, packed, indexed, laced, b"", good[:8]])
    status = {r.image_id: r for r in image_status(df).collect()}
    assert status[0].crc_ok and status[0].adler_ok and not status[0].truncated
    assert status[1].truncated and not status[2].crc_ok
    assert status[3].unsupported and status[4].unsupported and status[5].unsupported
    assert {r.image_id for r in decode(df).select("image_id").distinct().collect()} <= {0, 2}


@pytest.mark.parametrize("bits", [24, 32])
@pytest.mark.parametrize("upside", [1, -1])
def test_bmp_to_png_and_back(spark, bits, upside):
    w, h, n = 5, 4, bits // 8
    random.seed(bits)
    grid = [[tuple(random.randrange(256) for _ in range(n)) for _ in range(w)] for _ in range(h)]
    rows = [b"".join(bytes([p[2], p[1], p[0], *p[3:]]) for p in row).ljust(-(-w * n // 4) * 4, b"\0") for row in grid]
    body = b"".join(rows[::-1] if upside > 0 else rows)
    content = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h * upside, 1, bits, 0, len(body), 0, 0, 0, 0) + body
    rasters = bmp.rasters(images(spark, [content, b"BMbroken"]))
    assert rasters.where("width IS NULL").count() == 1 and bmp.field(rasters, "bits").where("image_id = 0").first().bits == bits
    got = {(r.y, r.x): (r.r, r.g, r.b, r.a)[:n] for r in decode(encode(rasters, bpp=n)).collect()}
    assert got == {(y, x): grid[y][x] for y in range(h) for x in range(w)}


def test_writers_read_back(spark, tmp_path):
    one = spark.range(1)
    content = F.concat(
        writer.signature(), writer.ihdr(F.lit(2), F.lit(2), F.lit(8), F.lit(3)), writer.plte(F.array(F.struct(F.lit(1).alias("r"), F.lit(2).alias("g"), F.lit(3).alias("b")))), writer.hist(F.array(F.lit(7))),
        writer.sbit(F.array(F.lit(8), F.lit(8), F.lit(8))), writer.bkgd(F.array(F.lit(1)), 1), writer.chrm(F.array(*[F.lit(i) for i in range(8)])), writer.srgb(F.lit(1)),
        writer.ztxt(F.lit("k"), F.lit(zlib.compress(b"zz"))), writer.time(F.to_timestamp(F.lit("2024-05-06 07:08:09"))), writer.idat(F.lit(bytes(40_000))), writer.iend(),
    )
    df = one.select(F.lit(0).cast("long").alias("image_id"), content.alias("content"), F.lit("a.png").alias("name"))
    rows = png.chunks(df)
    assert rows.where("NOT crc_ok").count() == 0 and png.counts(rows).first().idat == 3
    assert png.bkgd(rows).first().palette_index == 1 and png.time(rows).first().minute == 8 and png.texts(rows).first().text == "zz"
    assert [tuple(r) for r in writer.write_files(df, str(tmp_path / "out")).collect()] == [("a.png", len((tmp_path / "out" / "a.png").read_bytes()))]
    back = png.read_files(spark, str(tmp_path / "out"))
    assert png.report(png.chunks(back)).count() == rows.count() and png.file_sizes(spark, str(tmp_path / "out")).first().length > 40_000
    with pytest.raises(Exception, match="plain file name"):
        writer.write_files(df.withColumn("name", F.lit("../x")), str(tmp_path / "out")).collect()


def test_streamed_files(spark, tmp_path):
    from chunkloom.streaming.images import stream_chunks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(make_png(3, 3, 0, 8)[0])
    query = stream_chunks(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("streamed").where("type = 'IEND'").count() == 1


def test_filters_undo_each_other():
    random.seed(3)
    for bpp in (1, 3, 4):
        rows = [bytes(random.randrange(256) for _ in range(bpp * 7)) for _ in range(6)]
        for kind in range(5):
            raw = filtered(rows, [kind] * 6, bpp)
            step = bpp * 7 + 1
            assert filters.undo_image([(kind, raw[i + 1 : i + step]) for i in range(0, len(raw), step)], bpp) == rows
    with pytest.raises(ValueError):
        filters.undo_row(9, np.zeros(3, np.uint8), np.zeros(3, np.uint8), 1)


def test_packed_bits_and_header(spark):
    r = spark.createDataFrame([("1",), ("00000001" + "1",)], "b string").select(F.hex(symbols.pack_bits(F.col("b"))).alias("h")).collect()
    assert [x.h for x in r] == ["01", "8001"]
    lengths = spark.createDataFrame([("litlen", 256, 1), ("litlen", 270, 3), ("dist", 4, 2), ("clen", 0, 2), ("clen", 15, 1)], "alphabet string, sym int, len int")
    h = symbols.block_header(lengths).first()
    assert (h.type, h.hlit, h.hdist, h.hclen) == (2, 14, 4, 15)


def test_swap_and_scale(spark):
    p = spark.createDataFrame([(1, 0, 0, 1, 2, 3, 4)], "image_id long, y int, x int, r int, g int, b int, a int")
    assert (pixels.swap_red_blue(p).first().r, pixels.upscale(p, 3).count()) == (3, 9)


def test_rest_works_without_the_optional_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['chunkloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'byte_histogram' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_dumps_and_assertion(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xffA"), 5)], "d binary, n long")
    r = df.select(by.hex_dump(F.col("d")).alias("h"), by.bit_string(F.col("n"), 4).alias("b"), by.assert_equal(F.col("n"), F.lit(5), "no").alias("n")).first()
    assert (r.h, r.b, r.n) == ("00 FF 41", "0101", 5)
    with pytest.raises(Exception, match="they differ"):
        df.select(by.assert_equal(F.col("n"), F.lit(6), "they differ")).collect()


def test_one_damaged_file_leaves_the_others_alone(spark):
    """An unknown filter, a width beyond 31 bits, a cut after a chunk, a cut signature: flagged, without pixels, beside a good file."""
    chunk = lambda tag, data: len(data).to_bytes(4, "big") + tag + data + zlib.crc32(tag + data).to_bytes(4, "big")
    head = lambda w, h: chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes((8, 0, 0, 0, 0)))
    data = lambda raw: chunk(b"IDAT", zlib.compress(raw))
    end, good = chunk(b"IEND", b""), png.SIGNATURE + head(3, 2) + data(b"\0abc\2\1\1\1")
    files = [(1, good + end), (2, png.SIGNATURE + head(3, 2) + data(b"\0abc\7abc") + end), (3, png.SIGNATURE + head(2**32 - 1, 2) + data(b"\0abc") + end), (4, good), (5, png.SIGNATURE[:5]), (6, b"")]
    images = spark.createDataFrame([(i, bytearray(c)) for i, c in files], "image_id long, content binary")
    got = {}
    for p in decode(images).collect():
        got.setdefault(p.image_id, {})[p.y, p.x] = p.r
    first = {(0, 0): 97, (0, 1): 98, (0, 2): 99}
    assert got == {1: {**first, (1, 0): 98, (1, 1): 99, (1, 2): 100}, 2: first, 4: got[1]}
    status = {r.image_id: r for r in image_status(images).collect()}
    assert {i for i, r in status.items() if r.truncated} == {4, 5, 6} and set(status) == {1, 2, 3, 4, 5, 6}


def test_bad_distance_is_an_error_row(spark):
    rows = [(1, 0, 0, 0, 97, None, None), (1, 0, 1, 1, None, 4, 1), (2, 0, 0, 0, 97, None, None), (2, 0, 1, 1, None, 3, 9)]
    tokens = spark.createDataFrame(rows, "stream_id long, block_no int, seq int, pos int, lit int, len int, dist int")
    got = {r.stream_id: r for r in lz77.expand_tokens(tokens).collect()}
    assert bytes(got[1].data) == b"aaaaa" and got[1].error is None and got[2].data is None and "before the start" in got[2].error


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.text("ab ", max_size=3000).map(str.encode)))
def test_own_streams_inflate(data):
    stream = encoder.zlib_stream(data, block=1000)
    assert zlib.decompress(stream) == data
    parts = list(deflate.walk(stream))
    assert {p[2] for p in parts} == {2} and [p[1] for p in parts] == [False] * (len(parts) - 1) + [True]


def test_own_streams_of_awkward_data(spark):
    skewed = bytes(v for k in range(24) for v in [k] * min(2**k, 4000))  # unlimited codes would have over 15 bits
    rows = [(1, b""), (2, b"a" * 200_000), (3, bytes(range(256)) * 300), (4, skewed), (5, None), (5, b"again"), (None, b"no id")]
    made = encoder.encode_streams(spark.createDataFrame(rows, "stream_id long, data binary")).collect()
    assert sorted((str(r.stream_id), None if r.data is None else zlib.decompress(bytes(r.data))) for r in made if r.data) == sorted((str(i), d) for i, d in rows if d is not None)
    assert [r.stream_id for r in made if r.data is None] == [5]
    assert encoder.encode_streams(spark.createDataFrame([], "stream_id long, data binary")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=100))
def test_limited_lengths(frequency):
    lengths = encoder.limited_lengths(np.array(frequency), 7)
    used = np.array(frequency) > 0
    assert ((lengths > 0) == used).all() and lengths.max() <= 7
    if used.sum() > 1:
        assert (2.0 ** -lengths[used]).sum() == 1
        order = np.argsort(np.array(frequency)[used], kind="stable")
        assert (np.diff(lengths[used][order]) <= 0).all() or len(set(frequency)) < len(frequency)


def test_orders_and_dictionary(spark):
    bins = spark.createDataFrame([(3, 5), (1, 5), (2, 9)], "value int, frequency long")
    assert [r.value for r in symbols.by_value(bins).collect()] == [1, 2, 3]
    assert [r.value for r in symbols.by_frequency(bins).collect()] == [2, 1, 3]
    matches = spark.createDataFrame([(1, 0, 7, 5, 4)], "stream_id long, block_no int, pos int, len int, dist int")
    places = spark.createDataFrame([(1, 0, 7), (1, 0, 8)], "stream_id long, block_no int, pos int")
    assert sorted((r.pos, r.len) for r in lz77.in_dictionary(matches, places).collect()) == [(7, 5), (8, None)]


def test_streams_are_walked_row_by_row(spark):
    """Repeated and missing ids, several blocks, matches into earlier blocks, damage: one row each, and nothing is shuffled."""
    random.seed(5)
    long = bytes(random.choice(b"aabbbcde") for _ in range(5000)) * 40
    texts = [(1, b"one one one one"), (1, b"another of that id"), (None, b"no id"), (2, long), (3, b"")]
    rows = [(i, bytearray(zlib.compress(d))) for i, d in texts] + [(4, bytearray(zlib.compress(long)[:-900])), (5, None)]
    df = deflate.inflate_streams(spark.createDataFrame(rows, "stream_id long, data binary"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = df.collect()
    assert sorted((str(r.stream_id), bytes(r.data)) for r in got if r.data is not None) == sorted((str(i), d) for i, d in texts)
    assert {r.stream_id for r in got if r.error} == {4, 5} and all(r.final and r.blocks >= 1 for r in got if not r.error)
    assert {r.blocks for r in got if r.stream_id == 2} == {len(list(deflate.walk(zlib.compress(long))))}


def test_own_walk_of_odd_turns_is_as_in_sql(spark, tmp_path):
    """Turns that share an id or have none, are null, empty, or of several blocks."""
    rows = "(1, 2, 'first first first'), (1, 2, 'second'), (1, 1002, 'x'), (2, 2, 'y'), (3, 1, NULL), (3, 2, ''), (NULL, 1, 'no id'), (4, 1, repeat('äbc ', 20000))"
    duckdb.sql(f"COPY (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, 'user' AS role, text FROM (VALUES {rows}) t(conv_id, turn, text)) TO '{tmp_path}/conversations.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    expected = con.sql(queries.ORACLES["deflate_own_walk"]).fetchall()
    assert sorted(map(str, map(tuple, queries.QUERIES["deflate_own_walk"](spark, str(tmp_path)).collect()))) == sorted(map(str, expected))


def test_codes_are_shortest_and_streams_join_at_any_bit():
    """Huffman's merges where they fit the limit, package-merge where not; blocks that end inside a byte."""
    assert encoder.limited_lengths(np.array([1, 1, 2, 4, 8]), 15).tolist() == [4, 4, 3, 2, 1]
    assert encoder.limited_lengths(np.array([1, 1, 2, 4, 8]), 3).tolist() == [3, 3, 3, 3, 1]
    data = bytes(range(256)) * 3 + b"abcabcabcabc" * 50
    for block in (1, 7, 100, 5000):
        assert zlib.decompress(encoder.zlib_stream(data[:1300], block)) == data[:1300]
