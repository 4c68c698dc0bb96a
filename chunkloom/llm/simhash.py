"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints at Hamming distance at most t agree, in at least one of m disjoint bit partitions, up to that partition's threshold, if the
thresholds (-1 or more) add up to t - m + 1. Correlated bits share a partition; the thresholds of the partitions are unequal and come from
dynamic programming over estimated candidate counts. A partition with threshold s is probed under each choice of s masked bits, so one
equi-key finds all its candidates; candidates are then verified on all bits.

Where sets of shingles are to be compared, texts are candidates if they share one of several bands instead: tuples of least hashes of
those same sets. Whether a pair of a given similarity shares a band does not hang on where the texts differ, so replaced, appended or cut
paragraphs are found as well as scattered words.

Equal fingerprints (or sets) are collapsed before the search. Within a bucket only a spanning forest of the verified links is written, so a large
group of copies gives no more rows than it has members. With a similarity of shingle sets asked for, those forests only say which nodes may
belong together: every link lies within a component of candidates. The sets of such a part are then compared exactly in blocks of bounded size,
and again a spanning forest of the links is written. Parts of several blocks are dealt anew a few times; candidate pairs between what is then
still apart are compared one by one, until none is left.

Cases: null and empty texts have fingerprint zero and are linked like others; texts shorter than a shingle are one shingle; very long
texts are read whole; repeated rows and ids share a component; null ids never name a component (it is null if no member has an id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import cut, power_tables, stored
from chunkloom.llm.components import connected_components, local_forest, with_least

BITS, SEED = 64, 42
MASK = (1 << BITS) - 1
#: Costs, in seconds, of writing, sorting and reading a probe row and of comparing a candidate pair; only their ratio matters.
PROBE_COST, PAIR_COST = 6e-6, 1.5e-8
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 19
#: Larger buckets are compared block by block.
SMALL_BUCKET = 128
#: Links held before they are reduced to a spanning forest.
HELD_LINKS = 300_000


@dataclass(frozen=True)
class Settings:
    """What is fingerprinted and how near counts.

    words: shingles of the fingerprint. distance: bits in which linked fingerprints may differ. similarity: if given, a link needs sets of
    shingles of at least this Jaccard similarity instead, whatever the distance of the fingerprints. Candidates share one of bands tuples of
    band_rows least hashes: at similarity J a pair is missed with probability (1 - J ** band_rows) ** bands. A 256-bit SimHash over the
    same shingles picks the candidates whose sets are compared.
    """

    words: int = 3
    distance: int = 3
    similarity: float | None = None
    bands: int = 24
    band_rows: int = 4

    @property
    def check_distance(self) -> int:
        """Expected distance at this similarity plus five standard deviations, so that hardly a link at the limit is missed."""
        share = math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi
        return int(256 * share + 5 * math.sqrt(256 * share * (1 - share)))


#: Links of the pipeline's stage: five-word shingles with a similarity of 0.8. Of pairs at just 0.8 the bands miss 3 in a million.
FIVE_WORDS = Settings(words=5, similarity=0.8)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of size words, joined by spaces; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many rows of hashes (n rows of whole 64-bit words) each bit is set. Sums of 255 bits at a time fit a byte."""
    counts = np.zeros(hashes.shape[1] * BITS, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255 * 64]).view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.uint8)
    return counts


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    return int(np.packbits(2 * _set_bits(hashes.astype("<u8")[:, None]) > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spread(hashes: np.ndarray, times: int) -> np.ndarray:
    """Columns of further independent hashes made from the first."""
    return np.stack([_mixed(hashes + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & MASK)) for i in range(times)], 1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of size words; of all its words if there are fewer.

    All texts are hashed together: words by sums of bytes times powers of an odd base, shingles by sums of their words' hashes.
    """
    raw = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    powers, inverses = power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)])])
    words = _mixed((sums[ends] - sums[starts]) * inverses[starts])
    first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    factors = np.random.default_rng(size).integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(words) - size + 1
    runs = _mixed(sum(words[k : k + n] * factors[k] for k in range(size))) if n > 0 else np.empty(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(_mixed((words[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def band_keys(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """A number for each band: a digest of the band_rows least 32-bit hashes of the set, each under its own multiplier."""
    n = settings.bands * settings.band_rows
    times = np.random.default_rng(SEED).integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)
    least, short = np.full(n, 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        least = np.minimum(least, (times[:, None] * short[None, at : at + 1024]).min(1))
    rows, keys = least.reshape(settings.bands, settings.band_rows).astype(np.uint64), np.zeros(settings.bands, np.uint64)
    for i in range(settings.band_rows):
        keys = _mixed(keys + np.uint64(0x9E3779B97F4A7C15) ^ rows[:, i])
    return keys


def text_fingerprint(text: str | None, settings: Settings = Settings()) -> int:
    hashes = shingle_hashes((text or "").encode().lower().split(), settings.words)
    return majority(hashes)


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a set of shingles, as four numbers; zero for an empty set."""
    bits = 2 * _set_bits(_spread(hashes, 4)) > len(hashes) if len(hashes) else np.zeros(4 * BITS, bool)
    return np.packbits(bits, bitorder="little").view("<u8")


#: Bytes of text whose shingles are hashed together, but for a single longer text.
HASHED_BYTES = 1 << 20


def text_portions(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts as UTF-8 in lists of about HASHED_BYTES bytes, or of one text."""
    out: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode()
        if out and size + len(raw) > HASHED_BYTES:
            yield out
            out, size = [], 0
        out.append(raw)
        size += len(raw)
    if out:
        yield out


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def fingerprint_rows(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), fp (64 bits as a signed long), check (32 bytes or null), bands (longs or null), node.

    node is fp, or, where sets are to be compared, the digest of the set: rows of one node have one set. One Arrow pass without a shuffle.
    """
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    key_type = chosen.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "digest", "fp", "check", "bands", "node"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if settings.similarity is None:
                prints = pa.array(np.array([text_fingerprint(t, settings) for t in texts], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), prints, pa.nulls(len(texts), pa.binary()), pa.nulls(len(texts), pa.list_(pa.int64())), prints], names)
                continue
            checks, keys, nodes = [], [], []
            for portion in text_portions(texts):
                for hashes in shingle_sets(portion, settings.words):
                    checks.append(set_fingerprint(hashes))
                    keys.append(band_keys(hashes, settings))
                    nodes.append(set_digest(hashes))
            marks = np.array(checks, np.uint64).reshape(-1, 4)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * settings.bands), pa.array(np.array(keys, np.uint64).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(marks[:, 0].copy().view(np.int64)), pa.array([m.tobytes() for m in marks], pa.binary()), bands, pa.array(np.array(nodes, np.uint64).view(np.int64))], names)

    return chosen.mapInArrow(work, f"doc_id {key_type}, digest long, fp long, check binary, bands array<long>, node long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often bits i and j are both set; over all of them, 4,160 sums a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n))], ["cell", "n"])

    sums = {r.cell: r.n for r in prints.select("fp").mapInArrow(work, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    flat = np.array([sums.get(i, 0.0) for i in range(BITS * BITS + 1)])
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of near equal size; each part takes up the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(correlation, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        part = [max(sorted(free), key=lambda b: correlation[b, sorted(free)].sum())]
        free.discard(part[0])
        while len(part) < (BITS * (i + 1)) // m - (BITS * i) // m:
            part.append(max(sorted(free), key=lambda b: correlation[b, part].sum()))
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def _candidate_share(agree: np.ndarray, masked: int) -> float:
    """Sum over all choices of masked bits of the chance that two fingerprints agree on the others."""
    ways = np.zeros(masked + 1)
    ways[0] = 1
    for q in agree:
        ways[1:] = ways[1:] * q + ways[:-1]
        ways[0] *= q
    return float(ways[masked])


def plan_partitions(n: int, both: np.ndarray, distance: int, most: int = 8) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe: the cheapest allocation over all numbers of partitions up to most."""
    p = np.diag(both) / max(n, 1)
    agree = 1 - 2 * p * (1 - p)
    n = max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, most + 1):
        parts, total = correlated_partitions(n, both, m), distance - m + 1
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in states.items():
                for t in range(-1, min(distance, len(part) - 1) + 1):
                    more = 0.0 if t < 0 else n * math.comb(len(part), t) * PROBE_COST + n * n / 2 * _candidate_share(agree[part], t) * PAIR_COST
                    if spent + t not in after or cost + more < after[spent + t][0]:
                        after[spent + t] = cost + more, [*chosen, t]
            states = after
        if total in states and (best is None or states[total][0] < best[0]):
            best = states[total][0], [(part, t) for part, t in zip(parts, states[total][1], strict=True) if t >= 0]
    assert best is not None
    return best[1]


def probe_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """Bits that must agree, for each partition and choice of masked bits."""
    out = []
    for bits, threshold in plan:
        whole = sum(1 << b for b in bits)
        out += [whole & ~sum(1 << b for b in masked) for masked in combinations(bits, threshold)]
    return out


class Linker:
    """Finds the verified links among the rows of buckets and keeps a spanning forest of them."""

    def __init__(self, settings: Settings) -> None:
        self.distance = settings.distance if settings.similarity is None else BITS
        self.check = settings.check_distance if settings.similarity is not None else None

    def near(self, prints: np.ndarray, checks: np.ndarray | None, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a and b that are near enough, and the distance of their checks (0 without checks)."""
        ok = np.bitwise_count(prints[a] ^ prints[b]) <= self.distance
        a, b = a[ok], b[ok]
        if checks is None or not len(a):
            return a, b, np.zeros(len(a), np.int64)
        apart = np.concatenate([np.bitwise_count(checks[a[i : i + 500_000]] ^ checks[b[i : i + 500_000]]).sum(1, dtype=np.int64) for i in range(0, len(a), 500_000)])
        ok = apart <= self.check
        return a[ok], b[ok], apart[ok]

    def small(self, prints: np.ndarray, checks: np.ndarray | None, bucket: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Near pairs of rows of one bucket, by their distance in the sorted order."""
        at, d = np.arange(len(bucket)), 1
        place = np.arange(len(bucket)) - np.maximum.accumulate(np.where(np.concatenate([[True], bucket[1:] != bucket[:-1]]), np.arange(len(bucket)), 0))
        while True:
            at = at[place[at] + d < size[at]]
            if not len(at):
                return
            yield self.near(prints, checks, at, at + d)
            d += 1

    def large(self, prints: np.ndarray, checks: np.ndarray | None, rows: np.ndarray, free: list[int]) -> np.ndarray:
        """(row, root) of one bucket of many rows. As long as it is large, it is split by exact blocks of the bits still free."""
        if len(rows) > BLOCK_ROWS and len(free) >= 4 * (self.distance + 1):
            blocks = [free[i :: self.distance + 1] for i in range(self.distance + 1)]
            keys = [prints[rows] & np.uint64(sum(1 << b for b in block)) for block in blocks]
            sizes = [np.unique(key, return_counts=True)[1].astype(float) for key in keys]
            if sum((n * n).sum() for n in sizes) < 0.5 * len(rows) ** 2:  # else splitting costs more than comparing all
                pairs = []
                for block, key in zip(blocks, keys, strict=True):
                    order = np.argsort(key, kind="stable")
                    cuts = np.flatnonzero(np.diff(key[order])) + 1
                    rest = [b for b in free if b not in block]
                    pairs += [self.large(prints, checks, part, rest) for part in np.split(rows[order], cuts) if len(part) > 1]
                return np.concatenate([p for p in pairs if len(p)] or [np.empty((0, 2), np.int64)])
        own, marks = prints[rows], None if checks is None else checks[rows]
        label, step = np.arange(len(rows)), max(1, BLOCK_CELLS // len(rows))
        while True:
            joined: list[np.ndarray] = []
            for at in range(0, len(rows), step):
                here = np.arange(at, min(at + step, len(rows)))
                near = np.bitwise_count(own[here, None] ^ own[None, :]) <= self.distance
                near[here - at, here] = False
                if marks is not None:
                    apart = sum(np.bitwise_count(marks[here, None, k] ^ marks[None, :, k]).astype(np.int32) for k in range(4))
                    near &= apart <= self.check
                # each row joins its neighbour of the lowest label, until no row has a neighbour with another label
                lowest = np.where(near, label[None, :], len(rows)).argmin(1)
                moves = near[here - at, lowest] & (label[lowest] < label[here])
                joined.append(np.stack([here[moves], lowest[moves]], 1))
            pairs = np.concatenate(joined)
            if not len(pairs):
                break
            label = local_forest(np.concatenate([pairs[:, 0], np.arange(len(rows))]), np.concatenate([pairs[:, 1], label]), len(rows))
        moved = np.flatnonzero(label != np.arange(len(rows)))
        return np.stack([rows[moved], rows[label[moved]]], 1)

    def links(self, probe: np.ndarray, key: np.ndarray, prints: np.ndarray, checks: np.ndarray | None, masks: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of a spanning forest over whole buckets (equal probe and key, sorted by them)."""
        change = np.concatenate([[True], (probe[1:] != probe[:-1]) | (key[1:] != key[:-1])])
        bucket = np.cumsum(change) - 1
        counts = np.bincount(bucket)
        size = counts[bucket]
        rows = np.flatnonzero((size > 1) & (size <= SMALL_BUCKET))
        pairs = []
        if len(rows):
            held: list[np.ndarray] = []
            for left, right, _ in self.small(prints[rows], None if checks is None else checks[rows], bucket[rows], size[rows]):
                held.append(np.stack([rows[left], rows[right]], 1))
                if sum(map(len, held)) > HELD_LINKS:
                    held = [self.forest(np.concatenate(held), len(probe))]
            pairs += held
        starts = np.flatnonzero(change)
        for b in np.flatnonzero(counts > SMALL_BUCKET):
            own = np.arange(starts[b], starts[b] + counts[b])
            pairs.append(self.large(prints, checks, own, [] if masks is None else [i for i in range(BITS) if not masks[probe[own[0]]] >> i & 1]))
        tree = self.forest(np.concatenate([p for p in pairs if len(p)] or [np.empty((0, 2), np.int64)]), len(probe))
        return tree[:, 0], tree[:, 1]

    def across(self, probe: np.ndarray, key: np.ndarray, prints: np.ndarray, checks: np.ndarray, label: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Near pairs of rows of one bucket (equal probe and key, sorted by them) with unlike labels: the nearest most of each row, and whether it has more."""
        change = np.concatenate([[True], (probe[1:] != probe[:-1]) | (key[1:] != key[:-1])])
        bucket = np.cumsum(change) - 1
        counts, starts = np.bincount(bucket), np.flatnonzero(change)
        mixed = (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts))[bucket]
        size = counts[bucket]
        found: list[tuple[np.ndarray, ...]] = []

        def keep(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
            order = np.lexsort((b, apart, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
            cut_off = np.repeat(np.diff(np.append(first, len(a))) > most, np.diff(np.append(first, len(a))))
            found.append((a[rank < most], b[rank < most], cut_off[rank < most]))

        rows = np.flatnonzero(mixed & (size <= SMALL_BUCKET))
        small = []
        if len(rows):
            for left, right, apart in self.small(prints[rows], checks[rows], bucket[rows], size[rows]):
                unlike = label[rows[left]] != label[rows[right]]
                small.append((rows[left[unlike]], rows[right[unlike]], apart[unlike]))
        if small:
            keep(*(np.concatenate(x) for x in zip(*small)))
        for b in np.flatnonzero((counts > SMALL_BUCKET) & mixed[starts]):
            own = np.arange(starts[b], starts[b] + counts[b])
            step = max(1, BLOCK_CELLS // len(own))
            for at in range(0, len(own), step):
                here = own[at : at + step]
                x, y = np.nonzero((label[here, None] != label[None, own]) & (here[:, None] < own[None, :]))
                keep(*self.near(prints, checks, here[x], own[y]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        return tuple(np.concatenate(x) for x in zip(*found))

    @staticmethod
    def forest(pairs: np.ndarray, n: int) -> np.ndarray:
        label = local_forest(pairs[:, 0], pairs[:, 1], n)
        moved = np.flatnonzero(label != np.arange(n))
        return np.stack([moved, label[moved]], 1)


def bucket_rows(nodes: DataFrame, masks: list[int] | None) -> DataFrame:
    """probe, key and the columns of nodes: a row for each node and mask, dealt and sorted by the masked bits; without masks, by bands."""
    columns = [c for c in nodes.columns if c != "bands"]
    if masks is None:
        probes = F.transform("bands", lambda key, i: F.struct(i.alias("probe"), key.alias("key")))
    else:
        # a constant array and a lambda: a CASE or struct for each mask would make generated code grow with their number
        signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
        probes = F.transform(signed, lambda m, i: F.struct(i.alias("probe"), F.col("fp").bitwiseAND(m).alias("key")))
    rows = nodes.select(*columns, F.explode(probes).alias("p")).select("p.probe", "p.key", *columns)
    return rows.repartition("probe", "key").sortWithinPartitions("probe", "key")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of bucket_rows as arrays; each portion holds whole buckets. check comes as four numbers a row."""

    def joined(parts: list[list]) -> list[np.ndarray]:
        return [np.concatenate(p) for p in zip(*parts, strict=True)]

    held: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = []
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name == "check":
                columns.append(np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4))
            else:
                columns.append(column.to_numpy(zero_copy_only=False).view(np.uint64) if name == "fp" else column.to_numpy(zero_copy_only=False))
        probe, key = columns[:2]
        same = (probe == probe[-1]) & (key == key[-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if last or (held and (held[-1][0][-1], held[-1][1][-1]) != (probe[0], key[0])):
            yield joined([*held, [c[:last] for c in columns]] if last else held)
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield joined(held)


def bucket_links(nodes: DataFrame, masks: list[int] | None, settings: Settings) -> DataFrame:
    """a, b: links between nodes (node, fp; check, bands) whose fingerprints agree under one of masks, or which share a band, and are near enough.

    One shuffle of a row for each node and mask or band; buckets are then read from sorted partitions as a stream.
    """
    checked = settings.similarity is not None
    dealt = bucket_rows(nodes.select("node", "fp", *(["check", "bands"] if checked else [])), masks)
    linker = Linker(settings)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for probe, key, node, prints, *checks in whole_buckets(batches):
            a, b = linker.links(probe, key, prints, checks[0] if checks else None, masks)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def pairs_across(nodes: DataFrame, settings: Settings, most: int) -> DataFrame:
    """a, b, more: candidate pairs of bucket_links between nodes (node, fp, check, bands, label) with unlike labels.

    A row of a bucket gives its nearest most partners; more says that it has others.
    """
    dealt = bucket_rows(nodes.select("node", "fp", "check", "label", "bands"), None)
    linker = Linker(settings)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for probe, key, node, prints, checks, label in whole_buckets(batches):
            a, b, more = linker.across(probe, key, prints, checks, label, most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(more)], ["a", "b", "more"])

    return dealt.mapInArrow(work, "a long, b long, more boolean")


def node_sets(links: DataFrame, nodes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """node, check, set: fingerprints and shingle sets (sorted hashes) of the nodes that links (a, b) name.

    Rows that may hold them are found by a node's smallest id; which of them does is told by the digest of its set, so that neither rows that
    share an id nor rows without one are taken for each other.
    """
    named = stored(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(nodes.select("node", "first_id"), "node"))
    ids = named.where("first_id IS NOT NULL").select(F.col("first_id").alias("doc_id")).distinct()
    texts = docs.join(ids, "doc_id", "left_semi").select("text")
    if not named.where("first_id IS NULL").isEmpty():
        texts = texts.unionByName(docs.where("doc_id IS NULL").select("text"))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in text_portions(batch.column(0).to_pylist()):
                sets = shingle_sets(portion, settings.words)
                digests = pa.array(np.array([set_digest(s) for s in sets], np.uint64).view(np.int64))
                checks = pa.array([set_fingerprint(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, checks, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "check", "set"])

    found = texts.mapInArrow(hash_sets, "node long, check binary, set binary").join(named.select("node"), "node", "left_semi")
    return stored(found.groupBy("node").agg(F.first("check").alias("check"), F.first("set").alias("set")))


#: Bytes of sets that are compared in one task, and cells of the table of members that is held for it.
BLOCK_BYTES, TABLE_CELLS = 8 << 20, 1 << 25


class SetCounts:
    """Counts what one set has in common with others: over bits of a table of members where that is small, else by search."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.bits = sets, None
        known, times = np.unique(np.concatenate(sets), return_counts=True)
        known = known[times > 1]
        if len(known) and len(sets) * len(known) <= TABLE_CELLS:
            table = np.zeros((len(sets), -(-len(known) // 64) * 64), bool)
            for row, own in zip(table, sets):
                at = np.searchsorted(known, own)
                row[at[known[np.minimum(at, len(known) - 1)] == own]] = True
            self.bits = np.packbits(table, axis=1).view(np.uint64)

    def with_each(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)
        own, flat = self.sets[i], np.concatenate([self.sets[j] for j in others])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        return np.add.reduceat(hit.astype(np.int64), np.cumsum([0] + [len(self.sets[j]) for j in others[:-1]]))


def similar_sets(checks: np.ndarray, sets: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers, a spanning forest of the pairs of sets that are similar enough.

    The rows nearest to the others come first: they join most of a group, and pairs within a component need no comparison.
    """
    n, limit, counts = len(sets), settings.check_distance, SetCounts(sets)
    sizes, label, fresh = np.array([len(s) for s in sets]), np.arange(n), np.ones(n, bool)
    apart = lambda i: np.bitwise_count(checks ^ checks[i]).sum(1, dtype=np.int64)
    close = np.array([np.maximum(0, limit + 1 - apart(i)).sum() for i in range(n)])
    a, b = [], []
    for i in np.argsort(-close, kind="stable").tolist():
        fresh[i] = False
        alike = (apart(i) <= limit) & (np.minimum(sizes, sizes[i]) >= settings.similarity * np.maximum(sizes, sizes[i]))
        others = np.flatnonzero(fresh & (label != label[i]) & alike)
        if not len(others):
            continue
        common = counts.with_each(i, others)
        linked = others[common >= settings.similarity * (sizes[others] + sizes[i] - common)]
        if len(linked):
            joined, first = np.unique(label[linked], return_index=True)
            a += [i] * len(joined)
            b += linked[first].tolist()
            label[np.isin(label, joined)] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def block_links(members: DataFrame, sets: DataFrame, settings: Settings, salt: int) -> DataFrame:
    """a, b: a spanning forest of the similar pairs within each block of a part. members: node, part, blocks.

    Each set crosses one shuffle; a task holds one block (some BLOCK_BYTES of sets) at a time.
    """
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")).drop("blocks").join(sets, "node")
    dealt = dealt.select("part", "block", "node", "check", "set").repartition("part", "block").sortWithinPartitions("part", "block", "node")

    def compared(nodes: list[int], checks: list[bytes], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            a, b = similar_sets(np.frombuffer(b"".join(checks), np.uint64).reshape(-1, 4), sets, settings)
            if len(a):
                own = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, checks, found = None, [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for i, (part, block, node, check) in enumerate(zip(*columns, strict=True)):
                if (part, block) != held:
                    yield from compared(nodes, checks, found)
                    held, nodes, checks, found = (part, block), [], [], []
                nodes.append(node)
                checks.append(check)
                found.append(np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64))
        yield from compared(nodes, checks, found)

    return dealt.mapInArrow(work, "a long, b long")


def verified_links(links: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The links (a, b) whose shingle sets are similar enough, compared exactly.

    Links are joined with the sets of both ends; the joins' skew is the engine's to split.
    """
    similarity = settings.similarity
    first = links.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


#: Partners of a row in a bucket that the first round between components compares; each further round takes this many times as many.
ROUND = 8
#: How often the nodes of a part of several blocks are dealt, each time to other blocks.
DEALT = 4


def similar_components(nodes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """node, root as connected_components gives them, over all candidate pairs whose sets are similar enough.

    Components of candidates are compared block by block. One block settles a part for good; what several blocks leave apart goes on to
    pairs between components.
    """
    tested = stored(bucket_links(nodes, None, settings).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sets = node_sets(tested, nodes, docs, settings)
    parts = connected_components(tested)
    parts = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct())
    sized = stored(parts.join(sets.select("node", F.octet_length("set").alias("n")), "node").select(F.col("root").alias("a"), F.col("node").alias("b"), "n"))
    blocks = sized.groupBy("a").agg(F.ceil(F.sum("n") / BLOCK_BYTES).alias("m"))
    members = stored(with_least(sized, blocks).select(F.col("b").alias("node"), F.col("a").alias("part"), F.greatest("m", F.lit(1)).alias("blocks")))
    passed = stored(block_links(members, sets, settings, 0))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return connected_components(passed)
    for salt in range(1, DEALT):
        passed = stored(passed.unionByName(block_links(large, sets, settings, salt)))
    return components_across(nodes, large.select("node", "part"), sets, passed, settings)


def components_across(nodes: DataFrame, parts: DataFrame, sets: DataFrame, passed: DataFrame, settings: Settings) -> DataFrame:
    """node, root over the links passed and all similar candidate pairs within parts (node, part).

    Only nodes of parts that hold several components are probed again, and only pairs between components are compared. A round takes each
    row's nearest partners, the next more of them, until no row has any left over: then every candidate pair was compared or lies within
    a component. Pairs within a component, which grow with the square of a group of copies, are never written.
    """
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    most, roots, tested = ROUND, connected_components(passed), None
    while True:
        labelled = parts.join(roots, "node", "left").select("node", "part", F.coalesce("root", "node").alias("label"))
        split = labelled.groupBy("part").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("part").alias("a"), F.lit(1).alias("m"))
        unsettled = with_least(labelled.select(F.col("part").alias("a"), F.col("node").alias("b"), "label"), split).select(F.col("b").alias("node"), "label")
        unsettled = stored(nodes.select("node", "fp", "check", "bands").join(unsettled, "node"))
        if unsettled.isEmpty():
            return roots
        pairs = stored(pairs_across(unsettled, settings, most).select(*ordered, "more").groupBy("a", "b").agg(F.max("more").alias("more")))
        fresh = pairs.select("a", "b") if tested is None else stored(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"))
        joined = stored(verified_links(fresh, sets, settings))
        if not joined.isEmpty():
            passed = stored(passed.unionByName(joined))
            roots = connected_components(passed)
        if pairs.where("more").isEmpty():
            return roots
        tested = fresh if tested is None else stored(tested.unionByName(fresh))
        most *= ROUND


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), fp, component, component_id for every row: the smallest id among all rows that links lead to.

    component tells components apart where no member has an id.

    Texts are read once. What is shuffled are fingerprints: distinct ones, then probe rows, then links; only bit sums reach the driver.
    """
    prints = cut(fingerprint_rows(docs, settings, key, text))
    nodes = cut(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("check").alias("check"), F.first("bands").alias("bands"), F.min("doc_id").alias("first_id")))
    if settings.similarity is None:
        roots = connected_components(bucket_links(nodes, probe_masks(plan_partitions(*bit_counts(nodes), settings.distance)), settings))
    else:
        roots = similar_components(nodes, docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), settings)
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("m"))
    members = rooted.select(F.col("root").alias("a"), F.col("node").alias("b"))
    named = with_least(members, names.withColumnRenamed("root", "a")).select(F.col("b").alias("node"), F.col("a").alias("component"), F.col("m").alias("component_id"))
    return prints.select("doc_id", "digest", "fp", "node").join(named, "node").select("doc_id", "digest", "fp", "component", "component_id")


def fingerprint_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
