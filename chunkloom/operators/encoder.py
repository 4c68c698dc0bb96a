"""DEFLATE streams made from tokens: dynamic blocks with codes of limited length, packed bit by bit."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.functions.dims import CODE_LENGTH_ORDER, distance_bands, length_bands
from chunkloom.operators.lz77 import BLOCK, block_tokens

#: Symbols of the three alphabets, the longest code of data and of code lengths, the symbol that ends a block.
LITLEN, DIST, CLEN, LONGEST, LONGEST_CLEN, END = 286, 30, 19, 15, 7, 256
Fields = tuple[np.ndarray, np.ndarray]


def merged_lengths(weights: list[int]) -> list[int]:
    """Lengths of a Huffman code of two weights or more."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above = [0] * (2 * len(weights) - 1)
    for node in range(len(weights), len(above)):
        (x, i), (y, j) = heapq.heappop(heap), heap[0]
        above[i] = above[j] = node
        heapq.heapreplace(heap, (x + y, node))
    depth = [0] * len(above)
    for i in range(len(above) - 2, -1, -1):
        depth[i] = depth[above[i]] + 1
    return depth[: len(weights)]


def limited_lengths(frequency: np.ndarray, longest: int) -> np.ndarray:
    """Code lengths of least total for these frequencies, none over longest; 0 where the frequency is 0.

    By Huffman's merges, and where those give a code over longest by package-merge. A single symbol gets a code of one bit.
    """
    used = np.flatnonzero(frequency)
    lengths = np.zeros(len(frequency), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("too many symbols for codes of this length")
    merged = merged_lengths(frequency[used].tolist())
    if max(merged) <= longest:
        lengths[used] = merged
        return lengths
    coins = [(int(frequency[s]), [int(s)]) for s in used]
    packages: list[tuple[int, list[int]]] = []
    for _ in range(longest):
        row = sorted(coins + packages, key=lambda c: c[0])
        packages = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(row[::2], row[1::2])]
    for _, symbols in packages[: len(used) - 1]:
        np.add.at(lengths, symbols, 1)
    return lengths


def stream_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes as the stream holds them: the first bit of a code lowest."""
    codes, code, before = np.zeros(len(lengths), np.int64), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths.tolist()) if n):
        code <<= n - before
        codes[s] = int(format(code, f"0{n}b")[::-1], 2)
        code, before = code + 1, n
    return codes


def coded_lengths(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra, extra bits) of a row of code lengths: repeats as 16, runs of zeros as 17 and 18, split from the left."""
    out: list[tuple[int, int, int]] = []
    edges = np.flatnonzero(np.diff(lengths, prepend=-1, append=-1))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        value, n = int(lengths[start]), end - start
        if value:
            out.append((value, 0, 0))
            n -= 1
        while n >= 3:
            take = min(n, 6 if value else 138)
            out.append((16, take - 3, 2) if value else (17, take - 3, 3) if take < 11 else (18, take - 11, 7))
            n -= take
        out += [(value, 0, 0)] * n
    return tuple(np.array(x, np.int64) for x in zip(*out))


def _banded(values: np.ndarray, bands: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, extra, extra bits) of lengths or distances."""
    codes, bases, bits = (np.array(x, np.int64) for x in zip(*bands))
    at = np.searchsorted(bases, values, side="right") - 1
    return codes[at], values - bases[at], bits[at]


def block_fields(found: list[tuple[int, int | None, int | None, int | None]], final: bool) -> Fields:
    """(value, bits) of all that a dynamic block of these tokens (pos, literal, length, distance) holds, in order."""
    match = np.array([t[1] is None for t in found], bool)
    symbol = np.array([t[2] if t[1] is None else t[1] for t in found] + [END], np.int64)
    match = np.append(match, False)
    extra, extra_bits = np.zeros((2, len(symbol)), np.int64)
    dist = np.array([t[3] for t in found if t[1] is None], np.int64)
    symbol[match], extra[match], extra_bits[match] = _banded(symbol[match], length_bands())
    dist, dist_extra, dist_bits = _banded(dist, distance_bands())

    lit_lengths = limited_lengths(np.bincount(symbol, minlength=LITLEN), LONGEST)
    dist_lengths = limited_lengths(np.bincount(dist, minlength=DIST), LONGEST)
    n_lit = max(END + 1, int(np.flatnonzero(lit_lengths)[-1]) + 1)
    n_dist = int(np.flatnonzero(dist_lengths)[-1]) + 1 if len(dist) else 1
    run, run_extra, run_bits = coded_lengths(np.concatenate([lit_lengths[:n_lit], dist_lengths[:n_dist]]))
    own = limited_lengths(np.bincount(run, minlength=CLEN), LONGEST_CLEN)
    order = np.array(CODE_LENGTH_ORDER)
    n_own = max(4, int(np.flatnonzero(own[order])[-1]) + 1)

    head = [(int(final), 1), (2, 2), (n_lit - 257, 5), (n_dist - 1, 5), (n_own - 4, 4), *((int(n), 3) for n in own[order[:n_own]])]
    lengths = np.stack([stream_codes(own)[run], run_extra], 1).ravel(), np.stack([own[run], run_bits], 1).ravel()
    # a token is up to four fields: symbol, extra bits of the length, distance, extra bits of the distance
    body = np.zeros((2, len(symbol), 4), np.int64)
    body[0, :, 0], body[1, :, 0] = stream_codes(lit_lengths)[symbol], lit_lengths[symbol]
    body[0, :, 1], body[1, :, 1] = extra, extra_bits
    body[0, match, 2], body[1, match, 2] = stream_codes(dist_lengths)[dist], dist_lengths[dist]
    body[0, match, 3], body[1, match, 3] = dist_extra, dist_bits
    first = np.array(head, np.int64).T
    return tuple(np.concatenate([first[i], lengths[i], body[i].ravel()]) for i in range(2))


def field_bits(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of fields one after another, the lowest bit of a field first."""
    place = np.arange(int(bits.sum())) - np.repeat(np.cumsum(bits) - bits, bits)
    return (np.repeat(value, bits) >> place & 1).astype(np.uint8)


def zlib_stream(data: bytes, block: int = BLOCK) -> bytes:
    """data as a zlib stream of dynamic blocks; each block's tokens stand alone. Empty data is one empty block.

    Blocks are written one at a time, the bits of a byte begun going on to the next; the last byte is filled with zeros.
    """
    out, begun = bytearray(b"\x78\x01"), np.empty(0, np.uint8)
    for at in range(0, max(len(data), 1), block):
        bits = np.concatenate([begun, field_bits(*block_fields(block_tokens(data[at : at + block]), at + block >= len(data)))])
        whole = len(bits) // 8 * 8
        out += np.packbits(bits[:whole], bitorder="little").tobytes()
        begun = bits[whole:]
    return bytes(out) + np.packbits(begun, bitorder="little").tobytes() + zlib.adler32(data).to_bytes(4, "big")


#: Bytes of streams that are sent on together, but for a single longer one.
SENT_BYTES = 1 << 22


def encode_streams(streams: DataFrame) -> DataFrame:
    """stream_id, data: zlib streams of byte streams (stream_id, data), null for null. One Arrow pass, no shuffle; a stream is one row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes | None] = []
            first = size = 0
            for i, raw in enumerate(batch.column(1), 1):
                made.append(zlib_stream(raw.as_py()) if raw.is_valid else None)
                size += len(made[-1] or b"")
                if size > SENT_BYTES or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(made)), pa.array(made, pa.binary())], ["stream_id", "data"])
                    made, first, size = [], i, 0

    chosen = streams.select("stream_id", "data")
    return chosen.mapInArrow(work, chosen.schema)
