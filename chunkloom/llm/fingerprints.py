"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes sets boundaries, with a strict mask before the normal chunk size and an easy one after it (normalised
chunking). A fingerprint is the set of the chunks' digests with their lengths; the share of one text's chunk bytes that another text
also has measures containment, wherever they stand.

Cases: null counts as empty; two empty texts have likeness 1, an empty and another text 0; equal texts have equal fingerprints; very long
texts are chunked whole; rows of equal id stand in the order of a digest of their texts, then of the texts; null ids stand last; a single row
is its own next; an empty table gives no row; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import power_tables, shuffle_width

LEAST, NORMAL, MOST = 8, 24, 96
STRICT_BITS, EASY_BITS = 6, 3
LENGTH_BITS, CODE_BYTES = 7, 5
PARTITION_BYTES = 24 << 20
#: Beyond 1.6 TB of text partitions grow; each is read as a stream from a sort that spills, so a task's memory does not grow with it.
MAX_PARTITIONS = 1 << 16
#: Sampled rows for each splitter (16 bytes each on the driver).
SAMPLES = 30

_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


def chunk_ends(raw: np.ndarray) -> list[int]:
    """Ends of the chunks of a byte array."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    gear = _GEAR[raw]
    for step in (1, 2, 4, 8):
        shifted = gear[:-step] << np.uint16(step)
        gear = gear.copy()
        gear[step:] += shifted[: n - step]
    easy = np.flatnonzero(gear < (1 << (16 - EASY_BITS)))
    strict = (gear[easy] < (1 << (16 - STRICT_BITS))).tolist()
    places = (easy + 1).tolist()
    places.append(n + MOST)
    strict.append(True)
    ends, start, at = [], 0, 0
    while n - start > LEAST:
        least, normal, most = start + LEAST, start + NORMAL, start + MOST
        while places[at] < least or (places[at] < normal and not strict[at]):
            at += 1
        start = min(places[at], most, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_codes(text: str) -> np.ndarray:
    """Sorted distinct codes of a text's chunks: digest and length in CODE_BYTES bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.array(chunk_ends(raw), np.int64)
    if not len(ends):
        return np.empty(0, np.uint64)
    powers, inverses = power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)])])
    starts = np.concatenate([[0], ends[:-1]])
    mixed = (sums[ends] - sums[starts]) * inverses[starts]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    digest = mixed >> np.uint64(64 - 8 * CODE_BYTES)
    return np.unique((digest >> np.uint64(LENGTH_BITS) << np.uint64(LENGTH_BITS)) | (ends - starts).astype(np.uint64))


def fingerprint_text(codes: np.ndarray) -> str:
    """CODE_BYTES bytes in hex for each code."""
    return codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - CODE_BYTES :].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's chunk bytes that b has too."""
    mask = np.uint64((1 << LENGTH_BITS) - 1)
    if not len(a):
        return 0.0 if len(b) else 1.0
    return float((np.intersect1d(a, b, assume_unique=True) & mask).sum() / (a & mask).sum())


def edited(text: str, following: str) -> str:
    """The last third replaced by the first as many code points of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (array of chunk codes as hex text) of every text; one Arrow pass without a shuffle."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint_text(chunk_codes(t or "")) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {key}, fingerprint string")


_PLACE = "struct<i:bigint,d:bigint>"


def _below(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are below place: a search in two levels of constant arrays."""
    size = max(16, int(len(splitters) ** 0.5))
    runs = [[{"i": i, "d": d} for i, d in splitters[k : k + size]] for k in range(0, len(splitters), size)]
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    less = lambda array: F.size(F.filter(array, lambda x: x < F.col("place")))
    before = less(constant([r[-1] for r in runs], f"array<{_PLACE}>"))
    inside = less(F.element_at(constant(runs, f"array<array<{_PLACE}>>"), F.least(before + 1, F.lit(len(runs)))))
    return F.when(before == len(runs), len(splitters)).otherwise(before * size + inside).cast("int")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and their likeness; next means next by descending doc_id.

    Texts are shuffled once, to ranges of places (doc_id, then a digest of the text, so that rows which share an id or have none spread).
    Splitters are places that occur, so the neighbour of a range's last row is known: that one row (two rows for each range in all) is sent
    to both ranges.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("i"), F.xxhash64(text).alias("d"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), place.alias("place"))
    facts = chosen.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"), F.max("place").alias("top")).first()
    n = int(min(MAX_PARTITIONS, max(shuffle_width(spark), -(-(facts.bytes or 0) // PARTITION_BYTES))))
    share = min(1.0, SAMPLES * n / max(1, facts.rows))
    drawn = sorted({(r.place.i, r.place.d) for r in chosen.select("place").sample(fraction=share, seed=5).collect()})
    top = (facts.top.i, facts.top.d) if facts.rows else None
    splitters = sorted({drawn[i * len(drawn) // n] for i in range(1, n)} - {top}) if drawn else []
    own = chosen.withColumn("bucket", _below(splitters) if splitters else F.lit(0)).withColumn("guest", F.lit(False))
    last = len(splitters)
    if splitters:
        # a splitter is the first of its range in descending order, so it follows the last row of the range above; the first row of all follows the last
        at = F.struct("bucket", "guest")
        occurs = F.array_contains(F.from_json(F.lit(json.dumps([{"i": i, "d": d} for i, d in splitters])), f"array<{_PLACE}>"), F.col("place"))
        above = F.when(F.col("place") == F.struct(F.lit(top[0]).cast("long").alias("i"), F.lit(top[1]).cast("long").alias("d")), 0).when(occurs, F.col("bucket") + 1)
        own = own.withColumn("at", F.explode(F.when(above.isNull(), F.array(at)).otherwise(F.array(at, F.struct(above.cast("int").alias("bucket"), F.lit(True).alias("guest"))))))
        own = own.select("doc_id", "text", "place", "at.bucket", "at.guest")
    ranged = own.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("place"), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first = held = None

        def close(following: tuple) -> None:
            key, text, codes = held
            changed = edited(text, following[1])
            other = chunk_codes(changed)
            out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint_text(codes), fingerprint_text(other), containment(codes, other), containment(codes, following[2])))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return batch

        ended = False
        for batch in batches:
            for key, text, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if ended:
                    continue
                current = key, text, chunk_codes(text) if held is None or text != held[1] else held[2]
                if held is not None:
                    close(current)
                first, held, ended = first or current, current, guest
                if len(out) >= 256:
                    yield flush()
        if held is not None and not ended:
            close(first)
        if out:
            yield flush()

    return ranged.select("doc_id", "text", "guest").mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
