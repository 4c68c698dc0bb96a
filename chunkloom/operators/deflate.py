"""DEFLATE: data through zlib, and block and token rows where the coding itself is the subject."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.dims import CODE_LENGTH_ORDER, distance_bands, length_bands
from chunkloom.operators.lz77 import expand


def _binary_pass(df: DataFrame, column: str, out: str, work) -> DataFrame:
    """All columns of df, then out (binary) and <out>_error, made from one binary column in an Arrow pass."""
    names = df.columns
    place = names.index(column)
    schema = df.withColumns({out: F.lit(None).cast("binary"), f"{out}_error": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, errors = [], []
            for raw in batch.column(place).to_pylist():
                try:
                    data.append(None if raw is None else work(raw))
                    errors.append(None)
                except (zlib.error, ValueError) as e:
                    data.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], [*names, out, f"{out}_error"])

    return df.mapInArrow(run, schema)


def deflate(df: DataFrame, column: str, out: str = "deflated", level: int = 6, strategy: int = 0) -> DataFrame:
    """zlib streams of a binary column. level 0 stores; strategy zlib.Z_FIXED takes the fixed codes."""

    def work(raw: bytes) -> bytes:
        c = zlib.compressobj(level, zlib.DEFLATED, 15, 8, strategy)
        return c.compress(raw) + c.flush()

    return _binary_pass(df, column, out, work)


def inflate(df: DataFrame, column: str, out: str = "inflated") -> DataFrame:
    """The data of zlib streams; a damaged one gives null and its error, not a lost row."""
    return _binary_pass(df, column, out, zlib.decompress)


class Bits:
    """A cursor over the bits of a byte string, the lowest bit of a byte first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.words, self.size, self.at = data[at:], max(0, 8 * (len(data) - at)), 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.words[byte : byte + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the stream ends inside a block")
        out = self.peek(n)
        self.at += n
        return out


#: Codes of at most so many bits are looked up at once.
QUICK = 9


class Codes:
    """Decoder of a canonical prefix code: (length, code) to symbol; quick: (length, symbol) by the next QUICK bits, None for longer codes."""

    def __init__(self, lengths: list[int]) -> None:
        self.symbol: dict[tuple[int, int], int] = {}
        self.quick: list[tuple[int, int] | None] = [None] * (1 << QUICK)
        code = before = 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - before
            self.symbol[n, code] = s
            if n <= QUICK and code >> n == 0:
                at = int(format(code, f"0{n}b")[::-1], 2)
                self.quick[at :: 1 << n] = [(n, s)] * (1 << QUICK - n)
            code, before = code + 1, n

    def take(self, bits: Bits) -> int:
        if (found := self.quick[bits.peek(QUICK)]) is not None:
            bits.take(found[0])
            return found[1]
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.take(1)
            if (found := self.symbol.get((n, code))) is not None:
                return found
        raise ValueError("no symbol has this code")


FIXED = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8
_LENGTHS = {c: (base, bits) for c, base, bits in length_bands()}
_DISTANCES = {c: (base, bits) for c, base, bits in distance_bands()}


def dynamic_lengths(bits: Bits) -> tuple[list[int], list[int]]:
    """Code lengths of the two alphabets of a dynamic block, from its header on."""
    hlit, hdist, hclen = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    own = [0] * 19
    for s in CODE_LENGTH_ORDER[:hclen]:
        own[s] = bits.take(3)
    codes, out = Codes(own), []
    while len(out) < hlit + hdist:
        s = codes.take(bits)
        if s < 16:
            out.append(s)
        elif s == 16:
            if not out:
                raise ValueError("a repeat has nothing before it")
            out += [out[-1]] * (3 + bits.take(2))
        else:
            out += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
    return out[:hlit], out[hlit : hlit + hdist]


def walk(data: bytes) -> Iterator[tuple[int, bool, int, list[tuple[int | None, int | None, int | None]]]]:
    """(block_no, final, type, tokens) of a zlib stream; a stored block's bytes are literals."""
    bits, number, final = Bits(data, 2), 0, False
    while not final:
        final, kind = bool(bits.take(1)), bits.take(2)
        found: list[tuple[int | None, int | None, int | None]] = []
        if kind == 0:
            bits.at = -(-bits.at // 8) * 8
            n, check = bits.take(16), bits.take(16)
            if n != check ^ 0xFFFF:
                raise ValueError("the length of a stored block fails its check")
            start = bits.at // 8
            if start + n > len(bits.words):
                raise ValueError("the stream ends inside a block")
            found = [(b, None, None) for b in bits.words[start : start + n]]
            bits.at += 8 * n
        elif kind == 3:
            raise ValueError("a block has the reserved type")
        else:
            litlen, dist = (FIXED, [5] * 30) if kind == 1 else dynamic_lengths(bits)
            first, second = Codes(litlen), Codes(dist)
            quick, words, mask = first.quick, bits.words, (1 << QUICK) - 1
            while True:
                # literals of short codes, as many as the next 64 bits hold, without a call for each
                start, at = bits.at >> 3, bits.at & 7
                ahead = int.from_bytes(words[start : start + 8], "little")
                while at <= 64 - QUICK and (known := quick[ahead >> at & mask]) is not None and known[1] < 256:
                    at += known[0]
                    found.append((known[1], None, None))
                if 8 * start + at > bits.size:
                    raise ValueError("the stream ends inside a block")
                bits.at = 8 * start + at
                if (s := first.take(bits)) < 256:
                    found.append((s, None, None))
                    continue
                if s == 256:
                    break
                if s not in _LENGTHS:
                    raise ValueError("a length code is out of range")
                base, extra = _LENGTHS[s]
                length = base + bits.take(extra)
                d = second.take(bits)
                if d not in _DISTANCES:
                    raise ValueError("a distance code is out of range")
                base, extra = _DISTANCES[d]
                found.append((None, length, base + bits.take(extra)))
        yield number, final, kind, found
        number += 1


def inflate_blocks(streams: DataFrame) -> DataFrame:
    """stream_id, block_no, final, type, n_tokens, error of zlib streams (stream_id, data). One task a stream: bits are sequential."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for stream, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number = 0
                try:
                    for number, final, kind, found in walk(data or b""):
                        rows.append((stream, number, final, kind, len(found), None))
                        number += 1
                except ValueError as e:
                    rows.append((stream, number, None, 3, 0, str(e)))
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["stream_id", "block_no", "final", "type", "n_tokens", "error"])

    return streams.select("stream_id", "data").mapInArrow(work, "stream_id long, block_no int, final boolean, type int, n_tokens int, error string")


def inflate_tokens(streams: DataFrame) -> DataFrame:
    """Token rows, as operators.lz77 has them, of zlib streams; a damaged stream gives those up to the damage."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for number, _, _, found in walk(data or b""):
                        n, pos, at = len(found), [], 0
                        for lit, length, _ in found:
                            pos.append(at)
                            at += 1 if lit is not None else length
                        lit, length, dist = zip(*found, strict=True) if found else ((), (), ())
                        columns = [pa.array([stream] * n, pa.int64()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(pos, pa.int32()), pa.array(["match" if x is None else "literal" for x in lit], pa.string())]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(lit, pa.int32()), pa.array(length, pa.int32()), pa.array(dist, pa.int32())], ["stream_id", "block_no", "seq", "pos", "kind", "lit", "len", "dist"])
                except ValueError:
                    continue

    return streams.select("stream_id", "data").mapInArrow(work, "stream_id long, block_no int, seq int, pos int, kind string, lit int, len int, dist int")


#: Bytes of data that are sent on together, but for a single longer stream; how far back a match reaches.
SENT_BYTES, WINDOW = 1 << 22, 1 << 15


def inflate_streams(streams: DataFrame) -> DataFrame:
    """stream_id, blocks, least_type, most_type, final, data, error of zlib streams (stream_id, data): walk's blocks, their tokens expanded.

    One row for each row, whatever its id, in one Arrow pass without a shuffle: a block's tokens are held at a time, and token rows are never
    made. A damaged stream, or null, gives the blocks before the damage, no data and the error.
    """
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
    names = ["stream_id", "blocks", "least_type", "most_type", "final", "data", "error"]

    def one(raw: bytes) -> tuple:
        out, types, final, error = bytearray(), [], False, None
        try:
            for _, final, kind, found in walk(raw):
                out += expand(found, bytes(out[-WINDOW:]))
                types.append(kind)
        except ValueError as e:
            error = str(e)
        return len(types), min(types, default=None), max(types, default=None), final, bytes(out) if error is None else None, error

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            first = size = 0
            for i, raw in enumerate(batch.column(1), 1):
                rows.append(one(raw.as_py() or b""))
                size += len(rows[-1][4] or b"")
                if size > SENT_BYTES or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)
                    rows, first, size = [], i, 0

    schema = f"stream_id {streams.schema['stream_id'].dataType.simpleString()}, blocks long, least_type int, most_type int, final boolean, data binary, error string"
    return streams.select("stream_id", "data").mapInArrow(work, schema)


def adler_ok(df: DataFrame, stream: str, data: str) -> DataFrame:
    """Adds adler_ok: whether the last four bytes of a zlib stream are the Adler-32 of its data."""
    from chunkloom.functions.bytes import adler32, be_uint

    return df.withColumn("adler_ok", be_uint(F.col(stream), F.octet_length(stream) - 3, 4) == adler32(F.col(data)))
