"""Removal of repeated byte strings with a distributed, sparse suffix array.

Every byte string of `length` bytes that also starts earlier (smaller doc_id, or same document and earlier start) is removed, overlaps
included, judged on the input.

Suffixes are sorted at anchors only: each window of `length` bytes is represented by its minimiser (the leftmost least hash among its
GRAM-byte strings), so equal windows have equal anchors at equal places. That leaves a suffix for about every 39th byte, and no window is
lost. A suffix travels with the bytes that its windows cover. Splitters from a sample range-partition the suffixes by their leading GRAM
bytes; each bucket is sorted by a multikey quicksort on 8-byte tokens. Neighbours with a common prefix shorter than GRAM are alone and done;
equal ones are settled at once; the windows of the rest, as far as the common prefixes reach, are sorted the same way. A leading string so
frequent that several splitters equal it is dealt over their buckets; each passes on the first of its equal suffixes, and these are compared
in a second round. There a suffix goes by runs of its windows, each dealt by a hash of all the bytes that the windows of the run share (RUN
bytes less than a window), so that a frequent opening does not bring together what differs after it.

Cases: null counts as empty; texts shorter than `length` keep all; null ids come last in order; rows of equal id are ordered by a digest of
their texts (64 bits), and equal rows are one document that appears several times (all get the same result); very long texts are read
whole, in segments; an empty table gives no row; extra columns are kept, but for those of the names of results and helpers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import cut, shuffle_width

LENGTH = 100
GRAM = 24
NO_ID = (1 << 63) - 1
#: Bytes of text that are cut into suffixes together, and of suffixes that a bucket should hold.
CHUNK_BYTES, BUCKET_BYTES = 3 << 20, 16 << 20
#: Bytes of text hashed together: bounds the arrays of 8 bytes for each byte of text.
PART_BYTES = 1 << 19
#: Longer texts are taken in overlapping segments, each with the windows that start in so many bytes (places within a part have 24 bits).
SEGMENT_BYTES = 1 << 22
SAMPLES_PER_BUCKET = 200
#: Bounds for any input: splitters (24 bytes each in a broadcast), sampled strings (24 bytes each on the driver), tasks of a shuffle. Where
#: there are more buckets than splitters, what lies between two splitters is dealt on by a hash of its leading bytes.
MAX_SPLITTERS, MAX_SAMPLES, MAX_PARTITIONS = 1 << 20, 1 << 22, 1 << 17
#: Repeated ids that are broadcast to tell their rows from others (8 bytes each); with more of them, every row carries its digest.
MAX_SHARED_IDS = 1 << 16
#: Offsets of windows before an anchor that go together in the second round.
RUN = 20
_HASH = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]
_PLACE_BITS = np.uint64(24)


class Layout:
    """Where a suffix record keeps its bytes: those before the anchor end at column `left`, the suffix starts there."""

    def __init__(self, length: int) -> None:
        if length < GRAM + 8:
            raise ValueError(f"repeats must be at least {GRAM + 8} bytes long")
        self.length, self.span = length, length - GRAM + 1
        self.left = -(-(self.span - 1) // 8) * 8
        self.right = -(-length // 8) * 8
        self.width = self.left + self.right


class Suffixes:
    """Records of suffixes: bytes, order of their document, start of their first window, bytes before the anchor, number of windows."""

    def __init__(self, rows: np.ndarray, doc: np.ndarray, digest: np.ndarray, first: np.ndarray, before: np.ndarray, windows: np.ndarray) -> None:
        self.rows, self.doc, self.digest, self.first, self.before, self.windows = rows, doc, digest, first, before, windows

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.rows[at], self.doc[at], self.digest[at], self.first[at], self.before[at], self.windows[at])

    def places(self, at: np.ndarray) -> Suffixes:
        """As take, without the bytes."""
        return Suffixes(self.rows[:0], self.doc[at], self.digest[at], self.first[at], self.before[at], self.windows[at])

    @staticmethod
    def join(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("rows", "doc", "digest", "first", "before", "windows")))

    def pack(self, layout: Layout) -> bytes:
        """Compressed; bytes that no window covers are left out, and numbers stand in planes of equal significance."""
        column = np.arange(layout.width)
        low = layout.left - self.before.astype(np.int64)
        body = self.rows[(column >= low[:, None]) & (column < (low + self.windows + layout.length - 1)[:, None])]
        planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :k].T) for c, k in ((self.doc, 8), (self.digest, 8), (self.first, 4))]
        return zstandard.ZstdCompressor(level=5).compress(b"".join(c.tobytes() for c in (*planes, self.before, self.windows, body)))

    @staticmethod
    def unpack(blobs: list[tuple[int, bytes]], layout: Layout) -> Suffixes:
        reader, parts = zstandard.ZstdDecompressor(), []
        for n, blob in blobs:
            raw, at, numbers = np.frombuffer(reader.decompress(blob), np.uint8), 0, []
            for k in (8, 8, 4):
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :k] = raw[at : at + n * k].reshape(k, n).T
                numbers.append(wide.view("<i8").ravel())
                at += n * k
            before, windows = raw[at : at + n], raw[at + n : at + 2 * n]
            rows, column = np.zeros((n, layout.width), np.uint8), np.arange(layout.width)
            low = layout.left - before.astype(np.int64)
            rows[(column >= low[:, None]) & (column < (low + windows + layout.length - 1)[:, None])] = raw[at + 2 * n :]
            parts.append(Suffixes(rows, *numbers, before, windows))
        return Suffixes.join(parts)

    def grams(self, layout: Layout) -> np.ndarray:
        return np.ascontiguousarray(self.rows[:, layout.left : layout.left + GRAM]).view(f"S{GRAM}").ravel()


def _suffixes_of_part(texts: list[bytes], docs: np.ndarray, digests: np.ndarray, bases: np.ndarray, layout: Layout) -> Suffixes:
    """The suffixes at the anchors of all windows of the texts; windows never cross texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    total, span = int(ends[-1]) if len(ends) else 0, layout.span
    raw = np.frombuffer(b"".join([bytes(layout.left), *texts, bytes(layout.right + 8)]), np.uint8)
    if total < layout.length:
        return Suffixes(np.empty((0, layout.width), np.uint8), *(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint8) for _ in range(2)))
    words = np.ndarray((total,), "<u8", raw, offset=layout.left, strides=(1,))
    n = total - GRAM + 1
    key = words[:n] * _HASH[0]
    key ^= words[8 : 8 + n] * _HASH[1]
    key ^= key >> np.uint64(31)
    key ^= words[16 : 16 + n] * _HASH[2]
    key ^= key >> np.uint64(29)
    key *= _HASH[3]
    key >>= _PLACE_BITS
    key <<= _PLACE_BITS
    key |= np.arange(n, dtype=np.uint64)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.uint64((1 << 64) - 1))
    padded[:n] = key
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - span + 1
    anchor = np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) & np.uint64((1 << 24) - 1)
    inside = np.zeros(count + 1, np.int32)  # windows that lie within one text
    starts = ends - lengths
    some = lengths >= layout.length
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, np.minimum(ends[some] - layout.length + 1, count), -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    anchor = anchor[at].astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.empty(0, np.int64)
    first, last = at[fresh], at[np.append(fresh[1:], len(at)) - 1] if len(at) else at
    place = anchor[fresh]
    rows = np.lib.stride_tricks.sliding_window_view(raw, layout.width)[place]
    column = np.arange(layout.width)
    low, high = layout.left - (place - first), layout.left + last + layout.length - place
    rows = np.where((column >= low[:, None]) & (column < high[:, None]), rows, np.uint8(0))
    owner = np.searchsorted(ends, first, side="right")
    return Suffixes(rows, docs[owner], digests[owner], first - starts[owner] + bases[owner], (place - first).astype(np.uint8), (last - first + 1).astype(np.uint8))


def suffixes_of(texts: list[bytes], docs: np.ndarray, digests: np.ndarray, bases: np.ndarray, layout: Layout) -> Suffixes:
    """The suffixes at the anchors of all windows of the texts, PART_BYTES of text at a time. bases: where each text starts in its document."""
    parts, at, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PART_BYTES or i == len(texts) - 1:
            parts.append(_suffixes_of_part(texts[at : i + 1], docs[at : i + 1], digests[at : i + 1], bases[at : i + 1], layout))
            at, size = i + 1, 0
    return Suffixes.join(parts) if parts else _suffixes_of_part([], docs, digests, bases, layout)


def tokens(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 8-byte tokens whose order is that of the bytes."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their columns of tokens, and a number for each run of equal rows in that order.

    A multikey quicksort, all its recursion levels side by side: rows are sorted by one token, and only those still equal to a neighbour go
    on to the next.
    """
    n = len(columns[0])
    order = np.argsort(columns[0], kind="stable")
    token = columns[0][order]
    fresh = np.concatenate([[True], token[1:] != token[:-1]]) if n else np.empty(0, bool)
    for column in columns[1:]:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(fresh[at])
        token = column[order[at]]
        inner = np.lexsort((token, run))
        order[at] = order[at][inner]
        token, run = token[inner], run[inner]
        fresh[at[1:]] |= (token[1:] != token[:-1]) & (run[1:] == run[:-1])
    return order, np.cumsum(fresh) - 1


def common_prefix(sorted_tokens: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the next one."""
    a, b = sorted_tokens[:-1], sorted_tokens[1:]
    unlike = a != b
    at = np.where(unlike.any(1), unlike.argmax(1), a.shape[1])
    inside = np.minimum(at, a.shape[1] - 1)
    rows = np.arange(len(a))
    difference = a[rows, inside] ^ b[rows, inside]
    zeros = sum((difference < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
    return np.where(at == a.shape[1], 8 * a.shape[1], 8 * at + zeros)


def not_first(run: np.ndarray, order: np.ndarray, s: Suffixes, start: np.ndarray) -> np.ndarray:
    """For rows in sorted order: False for those that come first among the equal ones, by document and start."""
    rank = np.lexsort((start, s.digest[order], s.doc[order], run))
    sorted_run = run[rank]
    opens = np.concatenate([[True], sorted_run[1:] != sorted_run[:-1]])
    least = rank[np.maximum.accumulate(np.where(opens, np.arange(len(rank)), 0))]
    same = (s.doc[order[rank]] == s.doc[order[least]]) & (s.digest[order[rank]] == s.digest[order[least]]) & (start[rank] == start[least])
    out = np.empty(len(run), bool)
    out[rank] = ~same
    return out


def alike(s: Suffixes, layout: Layout) -> np.ndarray:
    """Row numbers of suffixes whose leading GRAM bytes another one has too."""
    lead = tokens(s.rows[:, layout.left : layout.left + GRAM])
    order, run = multikey_sort([lead[:, i] for i in range(GRAM // 8)])
    return order[np.bincount(run)[run] > 1] if len(order) else order


def settle_equal(s: Suffixes, layout: Layout) -> tuple[Suffixes, list[tuple[np.ndarray, ...]]]:
    """The first of each set of wholly equal suffixes, in suffix order; and (doc, digest, start, end) that the others lose."""
    words = tokens(s.rows)
    at = layout.left // 8
    columns = [words[:, i] for i in (*range(at, words.shape[1]), *range(at))]
    order, run = multikey_sort([*columns, s.before.astype(np.uint64) << np.uint64(8) | s.windows])
    later = not_first(run, order, s, s.first[order])
    lost = order[later]
    # of rows of one repeated document only one goes on
    kept, kept_run = order[~later], run[~later]
    one = np.concatenate([[True], kept_run[1:] != kept_run[:-1]]) if len(kept) else np.empty(0, bool)
    return s.take(kept[one]), [(s.doc[lost], s.digest[lost], s.first[lost], s.first[lost] + s.windows[lost] - 1 + layout.length)]


def settle_windows(s: Suffixes, layout: Layout, most: int = 400_000) -> list[tuple[np.ndarray, ...]]:
    """(doc, digest, start, end) that windows of different suffixes lose. s: distinct suffixes, sorted from the anchor on."""
    if len(s) < 2:
        return []
    words = tokens(s.rows[:, layout.left :])
    shared = common_prefix(words)
    reach = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
    # a window that starts o bytes before the anchor needs length - o bytes from there on
    most_o = s.before.astype(np.int64)
    least_o = np.maximum(most_o - s.windows + 1, layout.length - reach)
    counts = np.maximum(0, most_o - least_o + 1)
    group = np.cumsum(np.concatenate([[True], shared < GRAM]))
    able = np.flatnonzero(counts)
    row = np.repeat(able, counts[able])
    o = np.arange(len(row)) - np.repeat(np.cumsum(counts[able]) - counts[able], counts[able]) + least_o[row]
    key = (group[row].astype(np.uint64) << np.uint64(8)) | o.astype(np.uint64)
    by_key = np.argsort(key, kind="stable")
    row, o, key = row[by_key], o[by_key], key[by_key]
    size = np.bincount(np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1) if len(key) else np.empty(0, np.int64)
    mate = np.repeat(size > 1, size)
    row, o, key = row[mate], o[mate], key[mate]
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    flat = np.lib.stride_tricks.sliding_window_view(np.append(s.rows.ravel(), np.zeros(8, np.uint8)), layout.right)
    out, at = [], 0
    while at < len(key):
        end = int(opens[np.searchsorted(opens, at + most, side="right") - 1]) if at + most < len(key) else len(key)
        if end <= at:
            after = np.searchsorted(opens, at, side="right")
            end = int(opens[after]) if after < len(opens) else len(key)
        r, k = row[at:end], o[at:end]
        content = flat[r * layout.width + layout.left - k]
        content[:, layout.length :] = 0
        words = tokens(content)
        order, run = multikey_sort([key[at:end], *(words[:, i] for i in range(words.shape[1]))])
        start = (s.first + s.before)[r] - k
        later = not_first(run, order, s.places(r), start[order])
        hit = order[later]
        r, start = r[hit], start[hit]
        by = np.lexsort((start, r))
        r, start = r[by], start[by]
        if len(r):
            fresh = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1)]))
            last = np.append(fresh[1:], len(r)) - 1
            out.append((s.doc[r[fresh]], s.digest[r[fresh]], start[fresh], start[last] + layout.length))
        at = end
    return out


_BLOBS = "bucket int, n int, data binary"
_FOUND = "doc long, digest long, start long, end long, bucket int, n int, data binary"
_FOUND_NAMES = ["doc", "digest", "start", "end", "bucket", "n", "data"]


def _keys(docs: DataFrame, text: str) -> DataFrame:
    """docs with _doc, the id as a number, and _digest: 64 bits of the text's hash where an id occurs more than once, else 0.

    Ids that occur once are most of them, and nothing about them need travel with each suffix.
    """
    keyed = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    shared = cut(keyed.groupBy("_doc").count().where("count > 1").select(F.col("_doc").alias("_shared")))
    n = shared.count()
    if not n:
        return keyed.withColumn("_digest", F.lit(0).cast("long"))
    if n > MAX_SHARED_IDS:
        return keyed.withColumn("_digest", F.xxhash64(text))
    marked = keyed.join(F.broadcast(shared), F.col("_doc") == F.col("_shared"), "left")
    return marked.withColumn("_digest", F.when(F.col("_shared").isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("_shared")


def segments(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of segments that together hold each string of length bytes once, and no other windows."""
    for start in range(0, max(1, len(text) - length + 1), SEGMENT_BYTES):
        yield start, text[start : start + SEGMENT_BYTES + length - 1]


def _chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, docs, digests, bases) of some CHUNK_BYTES; texts without a window are left out."""
    texts: list[bytes] = []
    facts: list[tuple[int, int, int]] = []
    size = 0

    def columns() -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        doc, digest, base = (np.array(c, np.int64) for c in zip(*facts, strict=True))
        return texts, doc, digest, base

    for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
        for doc, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if text is None or len(text) < least:
                continue
            for base, piece in segments(text, least):
                if texts and size + len(piece) > CHUNK_BYTES:
                    yield columns()
                    texts, facts, size = [], [], 0
                texts.append(piece)
                facts.append((doc, digest, base))
                size += len(piece)
    if texts:
        yield columns()


def _splitters(rows: DataFrame, buckets: int, total: int, layout: Layout) -> np.ndarray:
    """buckets - 1 leading strings that deal a sample of suffixes evenly; some MAX_SAMPLES strings at most reach the driver."""
    anchors = max(1.0, 2 * total / (layout.span + 1))
    share = min(1.0, min(MAX_SAMPLES, SAMPLES_PER_BUCKET * buckets) / anchors)
    # whole documents are drawn, at a higher share, and then some of their suffixes, so that few texts are read into Python
    drawn = min(1.0, max(share * 4, 200 / max(1, rows.sparkSession.sparkContext.defaultParallelism * 1000)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(1)
        for texts, docs, digests, bases in _chunks(batches, layout.length):
            grams = suffixes_of(texts, docs, digests, bases, layout).grams(layout)
            some = grams[random.random(len(grams)) < share / drawn]
            yield pa.RecordBatch.from_arrays([pa.array([some.astype(f"S{GRAM}").tobytes()], pa.binary())], ["grams"])

    got = rows.sample(fraction=drawn, seed=3).mapInArrow(sample, "grams binary").collect() if drawn < 1 else rows.mapInArrow(sample, "grams binary").collect()
    grams = np.sort(np.frombuffer(b"".join(bytes(r.grams) for r in got), f"S{GRAM}"))
    if not len(grams) or buckets == 1:
        return np.empty(0, f"S{GRAM}")
    return grams[(np.arange(1, buckets) * len(grams)) // buckets]


def window_runs(s: Suffixes, layout: Layout) -> Iterator[tuple[np.ndarray, Suffixes]]:
    """(hashes of what they share, records) of the windows of s by runs of offsets before the anchor.

    Equal windows have equal offsets, so they come in the same run, and under the same hash.
    """
    most, least = s.before.astype(np.int64), s.before.astype(np.int64) - s.windows + 1
    for low in range(0, layout.span, RUN):
        high = min(low + RUN, layout.span) - 1
        at = np.flatnonzero((most >= low) & (least <= high))
        if len(at):
            top, bottom = np.minimum(most[at], high), np.maximum(least[at], low)
            part = Suffixes(s.rows[at], s.doc[at], s.digest[at], s.first[at] + most[at] - top, top.astype(np.uint8), (top - bottom + 1).astype(np.uint8))
            shared = np.ascontiguousarray(part.rows[:, layout.left - low : layout.left + layout.length - high])
            words = np.zeros((len(at), -(-shared.shape[1] // 8) * 8), np.uint8)
            words[:, : shared.shape[1]] = shared
            key = np.full(len(at), low + 1, np.uint64) * _HASH[2]
            for column in words.view("<u8").T:
                key = (key ^ column) * _HASH[0]
                key ^= key >> np.uint64(29)
            yield key, part


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, digest, start, end: byte spans (they may overlap) that repeat an earlier string of length bytes. rows: doc, digest, text.

    One shuffle of compressed suffix blobs (a row for each bucket and chunk of text, not for each suffix), which no key can skew in rows.
    """
    layout = Layout(length)
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(shuffle_width(spark), -(-int(total * 2 * layout.width / (layout.span + 1)) // BUCKET_BYTES))
    ranges = min(MAX_SPLITTERS, wanted)
    within = -(-wanted // ranges)
    splitters = _splitters(rows, ranges, total, layout)
    shared = spark.sparkContext.broadcast(splitters)
    equal = splitters[1:][splitters[1:] == splitters[:-1]]
    frequent = np.unique(equal)
    often = spark.sparkContext.broadcast(frequent)
    second = max(shuffle_width(spark), 4 * len(equal) * within)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, digests, bases in _chunks(batches, layout.length):
            s = suffixes_of(texts, ids, digests, bases, layout)
            if not len(s):
                continue
            grams = s.grams(layout)
            low, high = np.searchsorted(shared.value, grams), np.searchsorted(shared.value, grams, side="right")
            deal = (s.doc.view(np.uint64) * _HASH[0] >> np.uint64(33)).astype(np.int64)
            bucket = np.where(high - low > 1, low + 1 + deal % np.maximum(1, high - low), high)
            if within > 1:
                lead = tokens(s.rows[:, layout.left : layout.left + GRAM])
                mixed = (lead[:, 0] * _HASH[0] ^ lead[:, 1] * _HASH[1] ^ lead[:, 2] * _HASH[2]) * _HASH[3] >> np.uint64(33)
                bucket = bucket * within + np.where(high - low > 1, deal, mixed.astype(np.int64)) % within
            order = np.lexsort((tokens(s.rows[:, layout.left : layout.left + 8]).ravel(), bucket))
            opens = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            parts = np.split(order, opens[1:])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[opens]].astype(np.int32)), pa.array(np.array([len(p) for p in parts], np.int32)), pa.array([s.take(p).pack(layout) for p in parts], pa.binary())], ["bucket", "n", "data"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
        """The suffixes of one bucket after the other: a partition is sorted by bucket."""
        held, blobs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(0)[i].as_py()
                if blobs and bucket != held:
                    yield Suffixes.unpack(blobs, layout)
                    blobs = []
                held = bucket
                blobs.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
        if blobs:
            yield Suffixes.unpack(blobs, layout)

    def spans(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for doc, digest, start, end in found:
            for i in range(0, len(doc), 50_000):
                k = slice(i, i + 50_000)
                m = len(doc[k])
                yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(digest[k]), pa.array(start[k].astype(np.int64)), pa.array(end[k].astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], _FOUND_NAMES)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in gathered(batches):
            s = s.take(alike(s, layout)) if not len(often.value) else s.take(np.union1d(alike(s, layout), np.flatnonzero(np.isin(s.grams(layout), often.value))))
            kept, found = settle_equal(s, layout)
            del s
            yield from spans(found)
            passed = np.isin(kept.grams(layout), often.value)
            yield from spans(settle_windows(kept.take(np.flatnonzero(~passed)), layout))
            if passed.any():
                for key, part in window_runs(kept.take(np.flatnonzero(passed)), layout):
                    bucket = (key % np.uint64(second)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
                    none = [pa.nulls(len(parts), pa.int64())] * 4
                    blobs = [part.take(p).pack(layout) for p in parts]
                    yield pa.RecordBatch.from_arrays([*none, pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array(blobs, pa.binary())], _FOUND_NAMES)

    def settle_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in gathered(batches):
            kept, found = settle_equal(s, layout)
            yield from spans([*found, *settle_windows(kept, layout)])

    def by_bucket(blobs: DataFrame, count: int) -> DataFrame:
        """Runs of buckets to partitions, each sorted by bucket, so that a task holds one bucket at a time."""
        n = min(MAX_PARTITIONS, count)
        at = F.expr(f"CAST(CAST(bucket AS LONG) * {n}L DIV {count}L AS INT)")
        return blobs.repartitionById(n, at).sortWithinPartitions("bucket")

    found = by_bucket(rows.mapInArrow(scatter, _BLOBS), ranges * within).mapInArrow(settle, _FOUND)
    if not len(frequent):
        return found.select("doc", "digest", "start", "end")
    found = cut(found)
    across = by_bucket(found.where("data IS NOT NULL").select("bucket", "n", "data"), second).mapInArrow(settle_across, _FOUND)
    return found.where("data IS NULL").unionByName(across).select("doc", "digest", "start", "end")


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """All columns of docs, then n_bytes, spans (array of start and end), kept (binary): what is left of each text.

    Columns of docs that have one of these three names, or that of a helper (_doc, _digest, _shared, _starts, _ends), give way.

    whole_characters: spans shrink to characters that lie in them wholly, so that kept is UTF-8.
    """
    docs = docs.drop("n_bytes", "spans", "kept", "_doc", "_digest", "_shared", "_starts", "_ends")
    keyed = _keys(docs, text)
    found = repeated_spans(keyed.select(F.col("_doc").alias("doc"), F.col("_digest").alias("digest"), F.col(text).alias("text")), length)
    spans = found.groupBy(F.col("doc").alias("_span_doc"), F.col("digest").alias("_span_digest")).agg(F.collect_list("start").alias("_starts"), F.collect_list("end").alias("_ends"))
    names = docs.columns
    place = names.index(text)
    schema = docs.withColumns({"n_bytes": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<struct<start:bigint,end:bigint>>"), "kept": F.lit(None).cast("binary")}).schema

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            packed = [None if raw is None else press(raw) for raw in batch.column(place).cast(pa.binary()).to_pylist()]
            columns = [pa.array(packed, pa.binary()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_doc", "_digest"])

    # texts cross the shuffle compressed: they are the largest part of what it moves
    small = keyed.mapInArrow(shrink, keyed.withColumn(text, F.lit(None).cast("binary")).schema)
    joined = small.join(spans, (F.col("_doc") == F.col("_span_doc")) & (F.col("_digest") == F.col("_span_digest")), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = zstandard.ZstdDecompressor().decompress
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            sizes, all_spans, kept = [], [], []
            raws = [None if x is None else full(x) for x in batch.column(place).to_pylist()]
            for raw, starts, ends in zip(raws, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                raw = raw or b""
                runs = merged(starts, ends) if starts else []
                if whole_characters and runs:
                    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80  # noqa: E731, B023
                    shrunk = []
                    for a, b in runs:
                        while a < b and inside(a):
                            a += 1
                        while b > a and inside(b):
                            b -= 1
                        shrunk += [(a, b)] if a < b else []
                    runs = shrunk
                sizes.append(len(raw))
                all_spans.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            original = [pa.array(raws, pa.binary()).cast(pa.string()) if i == place else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*original, pa.array(sizes, pa.int64()), pa.array(all_spans, span_type), pa.array(kept, pa.binary())], [*names, "n_bytes", "spans", "kept"])

    return joined.select(*names, "_starts", "_ends").mapInArrow(strip, schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kept = without_repeats(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
