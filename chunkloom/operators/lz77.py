"""LZ77 tokens of byte blocks, and their expansion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.dims import MAX_MATCH, distance_code, length_code

BLOCK = 32768
LEAST_MATCH = 4
#: Bytes at the start of a block that never start a match.
UNREADY = 6
TOKEN = "stream_id long, block_no int, seq int, pos int, kind string, lit int, len int, dist int"


def blocks(streams: DataFrame, block: int = BLOCK) -> DataFrame:
    """stream_id, block_no, data of streams (stream_id, data): tumbling blocks by byte offset, the last one short."""
    n = F.octet_length("data")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("block_no"), F.substring(F.col("data"), i * block + 1, F.lit(block)).alias("data")))
    return streams.select("stream_id", F.explode(cut).alias("b")).select("stream_id", "b.block_no", "b.data")


def longest_match(data: bytes, at: int, most: int = MAX_MATCH) -> tuple[int, int]:
    """(length, start) of the longest string at `at` that also lies wholly before at - 1, at its earliest place; (0, 0) below LEAST_MATCH."""
    low, high, best = LEAST_MATCH, min(most, len(data) - at, at - 1), (0, 0)
    if high < low or (start := data.find(data[at : at + low], 0, at - 1)) < 0:
        return best
    # the string at an earlier place grows as far as it matches; only a later place can beat it
    length = low
    while True:
        while length < high and start + length < at - 1 and data[start + length] == data[at + length]:
            length += 1
        best = (length, start)
        if length >= high:
            return best
        start = data.find(data[at : at + length + 1], start + 1, at - 1)
        if start < 0:
            return best
        length += 1


def block_tokens(data: bytes) -> list[tuple[int, int | None, int | None, int | None]]:
    """(pos, literal, length, distance) of a block: greedy, one position or one match at a time."""
    out: list[tuple[int, int | None, int | None, int | None]] = []
    at = 0
    while at < len(data):
        length, start = longest_match(data, at) if at >= UNREADY else (0, 0)
        if length:
            out.append((at, None, length, at - start))
            at += length
        else:
            out.append((at, data[at], None, None))
            at += 1
    return out


def tokens(block_rows: DataFrame) -> DataFrame:
    """Token rows of blocks. Blocks are independent; each is one row of an Arrow pass, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, number, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = block_tokens(data)
                if not found:
                    continue
                pos, lit, length, dist = zip(*found, strict=True)
                n = len(found)
                columns = [pa.array([stream] * n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(pos, pa.int32()), pa.array(["match" if x is None else "literal" for x in lit])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lit, pa.int32()), pa.array(length, pa.int32()), pa.array(dist, pa.int32())], [f.split()[0] for f in TOKEN.split(", ")])

    return block_rows.select(F.col("stream_id").cast("long"), "block_no", "data").mapInArrow(work, TOKEN)


def with_codes(token_rows: DataFrame) -> DataFrame:
    """Adds symbol (literal or length code), length_extra, dist_code, dist_extra; raw values stay."""
    length, dist = length_code(F.col("len")), distance_code(F.col("dist"))
    return token_rows.select("*", F.coalesce("lit", length.code).alias("symbol"), length.extra.alias("length_extra"), dist.code.alias("dist_code"), dist.extra.alias("dist_extra"))


def symbol_stream(token_rows: DataFrame) -> DataFrame:
    """stream_id, alphabet, pos, value of the two symbol streams, with the end-of-block symbol 256 after each block's last token."""
    coded = with_codes(token_rows)
    both = coded.select("stream_id", "block_no", F.lit("litlen").alias("alphabet"), "pos", F.col("symbol").alias("value"))
    dist = coded.where("kind = 'match'").select("stream_id", "block_no", F.lit("dist").alias("alphabet"), "pos", F.col("dist_code").alias("value"))
    end = token_rows.groupBy("stream_id", "block_no").agg((F.max("pos") + 1).cast("int").alias("pos")).select("stream_id", "block_no", F.lit("litlen").alias("alphabet"), "pos", F.lit(256).alias("value"))
    return both.unionByName(dist).unionByName(end)


def expand(found: Iterable[tuple[int | None, int | None, int | None]], history: bytes = b"") -> bytes:
    """Bytes of tokens (literal, length, distance); a match may overlap itself and reach into the history."""
    out = bytearray(history)
    for lit, length, dist in found:
        if lit is not None:
            out.append(lit)
        elif dist is None or length is None or dist > len(out) or dist < 1:
            raise ValueError("a match reaches before the start")
        elif dist >= length:
            out += out[-dist : len(out) - dist + length]
        else:
            piece = bytes(out[-dist:])
            out += (piece * (length // dist + 1))[:length]
    return bytes(out[len(history) :])


def expand_tokens(token_rows: DataFrame, chained: bool = False) -> DataFrame:
    """stream_id, block_no, data, error. chained: matches may reach into earlier blocks of the stream (then block_no is 0 for the whole).

    Tokens that cannot be expanded give no data but an error, and leave other streams alone.

    A block's tokens (at most BLOCK of them) are gathered in one row; with chained, a stream's. One row at a time becomes Python objects.
    """
    keys = ["stream_id"] if chained else ["stream_id", "block_no"]
    order = F.struct("block_no", "seq", "lit", "len", "dist")
    rows = token_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("t"))
    rows = rows.select("stream_id", F.lit(0).alias("block_no") if chained else "block_no", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, errors = [], []
            for t in batch.column(2):
                try:
                    data.append(expand(zip(*(t.values.field(name).to_pylist() for name in ("lit", "len", "dist")), strict=True)))
                    errors.append(None)
                except ValueError as e:
                    data.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["stream_id", "block_no", "data", "error"])

    return rows.mapInArrow(work, "stream_id long, block_no int, data binary, error string")


def in_dictionary(matches: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (stream_id, block_no, pos) with the match that starts there, if any."""
    return positions.join(matches.select("stream_id", "block_no", "pos", "len", "dist"), ["stream_id", "block_no", "pos"], "left")
