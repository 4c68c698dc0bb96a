"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_k [(sum_i v_ik x_i)^2 - sum_i v_ik^2 x_i^2]); the last form needs one pass over the
features instead of one over their pairs.

Cases: null and empty texts have structure features only and get a score like any other; very long texts are read whole; repeated
rows get equal scores; null and repeated ids are passed on; an empty table gives no row; extra columns, whatever their names, are
ignored; without any training row the score is 0.5 for all.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.classifier_data import labelled_sample
from chunkloom.llm.common import held_out

BINS = 12
CACHE_WORDS = 150_000
#: Characters of text scored together, but for a single longer text: bounds the arrays of rank floats for each word.
SCORED_CHARS = 1 << 21


@dataclass(frozen=True)
class Settings:
    word_buckets: int = 1 << 15
    rank: int = 8
    epochs: int = 6
    batch: int = 256
    rate: float = 0.08
    l2: float = 2e-5
    seed: int = 20

    @property
    def width(self) -> int:
        return self.word_buckets + len(STATISTICS) * BINS


def _share(part: float, whole: float) -> int:
    """Bin of a share from 0 to 1, finer near 0."""
    return min(BINS - 1, int(math.sqrt(part / whole) * BINS)) if whole > 0 else 0


def _size(n: float) -> int:
    return min(BINS - 1, int(math.log2(n + 1) * 0.75))


STATISTICS = (
    "upper", "digit", "bang", "bar", "punctuation", "repeated_lines", "repeated_words", "commonest_word", "word_length",
    "line_words", "non_ascii", "upper_words", "sentence_ends", "long_words", "length",
)


def statistics(text: str, words: list[str], counts: Counter) -> list[int]:
    """One bin for each of STATISTICS. The last is metadata of the text: its length class."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, k = max(1, raw.size), len(words)
    kinds = np.bincount(raw, minlength=256)
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    return [
        _share(upper, max(1, upper + lower)),
        _share(int(kinds[48:58].sum()), n),
        _share(int(kinds[33]), n),
        _share(int(kinds[124]), n),
        _share(int(kinds[[34, 39, 40, 41, 44, 45, 47, 58, 59, 91, 93]].sum()), n),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(k - len(counts), k),
        _share(max(counts.values(), default=0), k),
        min(BINS - 1, int(len(text) / (k + 1))),
        _size(k / max(1, len(lines))),
        _share(int(kinds[128:].sum()), n),
        _share(sum(map(str.isupper, words)), k),
        _share(int(kinds[46] + kinds[63]), k),
        _share(sum(1 for w in counts if len(w) > 14), len(counts)),
        _size(len(text)),
    ]


class Features:
    """Turns texts into feature ids and values; remembers the buckets of words it has seen."""

    def __init__(self, settings: Settings) -> None:
        self.settings, self.seen = settings, {}

    def _bucket(self, word: str) -> int:
        if len(self.seen) >= CACHE_WORDS:
            self.seen.clear()
        got = self.seen[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.settings.word_buckets
        return got

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        seen, bucket = self.seen, self._bucket
        found = [seen[w] if w in seen else bucket(w) for w in counts]
        k, base = len(found), self.settings.word_buckets
        stats = [base + i * BINS + b for i, b in enumerate(statistics(text, words, counts))]
        ids = np.array(found + stats, np.int32)
        values = np.empty(len(ids), np.float32)
        values[k:] = 1
        if k:
            tf = 1 + np.log(np.fromiter(counts.values(), np.float32, k))
            values[:k] = tf / np.sqrt((tf * tf).sum())
        return ids, values

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self.of(t or "") for t in texts]
        starts = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), starts


@dataclass
class Machine:
    """Weights of a fitted factorisation machine: (1 + rank) floats a feature, 1.2 MB with the default settings."""

    settings: Settings
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = (sums * sums - np.add.reduceat(vx * vx, starts, axis=0)).sum(1) / 2
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts) + pairs, sums, vx

    def scores(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, starts)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Machine:
    """Adaptive-gradient fit of the logistic loss; classes weigh the same. Rows come in a fixed order, so equal input gives equal weights."""
    random = np.random.default_rng(settings.seed)
    machine = Machine(settings, 0.0, np.zeros(settings.width, np.float32), random.normal(0, 0.01, (settings.width, settings.rank)).astype(np.float32))
    labels = np.array([y for _, _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        machine.factors[:] = 0
        machine.bias = 0.0 if not len(rows) else (3.0 if labels[0] else -3.0)
        return machine
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    g_bias, g_linear, g_factors = 1e-6, np.full(settings.width, 1e-6, np.float32), np.full((settings.width, settings.rank), 1e-6, np.float32)
    for _ in range(settings.epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            picked = order[at : at + settings.batch]
            lengths = np.array([len(rows[i][0]) for i in picked])
            ids, values = np.concatenate([rows[i][0] for i in picked]), np.concatenate([rows[i][1] for i in picked])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            raw, sums, vx = machine.raw(ids, values, starts)
            slope = (weight[picked] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[picked]) / len(picked)).astype(np.float32)
            each = np.repeat(slope, lengths)
            used, back = np.unique(ids, return_inverse=True)
            d_linear = np.bincount(back, each * values, len(used)).astype(np.float32) + settings.l2 * machine.linear[used]
            inner = each[:, None] * values[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
            d_factors = np.stack([np.bincount(back, inner[:, k], len(used)) for k in range(settings.rank)], 1).astype(np.float32) + settings.l2 * machine.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            machine.linear[used] -= settings.rate * d_linear / np.sqrt(g_linear[used])
            machine.factors[used] -= settings.rate * 0.5 * d_factors / np.sqrt(g_factors[used])
            g_bias += float(slope.sum()) ** 2
            machine.bias -= settings.rate * float(slope.sum()) / math.sqrt(g_bias)
    return machine


def sent_features(ids: np.ndarray, values: np.ndarray) -> bytes:
    """Feature ids and values of a row as a task sends them, lossless and in order: first bytes, then second bytes and so on, compressed."""
    return zlib.compress(np.stack([ids.view(np.float32), values]).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def received_features(sent: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(zlib.decompress(sent), np.uint8).reshape(4, -1).T).reshape(2, -1)
    return both[0].view(np.int32), both[1].view(np.float32)


def train(documents: DataFrame, labels: DataFrame, settings: Settings | None = None, max_rows_per_class: int | None = None) -> Machine:
    """Fit on a bounded sample of labelled rows (classifier_data.MAX_ROWS_PER_CLASS of each class).

    Executors turn texts into feature ids, so the driver receives some three bytes for each distinct word of the sampled rows, never texts.
    """
    settings = settings or Settings()
    sample = labelled_sample(documents, labels, "quality", *([max_rows_per_class] if max_rows_per_class else []))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings)
        for batch in batches:
            got = [sent_features(*features.of(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(got, pa.binary())], ["doc_id", "y", "sent"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(featurise, "doc_id string, y int, sent binary").collect()
    known = [(r.doc_id, r.y, *received_features(bytes(r.sent))) for r in rows]
    known.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[1], r[2].tobytes()))
    return fit([(ids, values, y) for _, y, ids, values in known], settings)


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in lists of at most SCORED_CHARS characters, or of one text."""
    out, size = [], 0
    for text in texts:
        if out and size + len(text or "") > SCORED_CHARS:
            yield out
            out, size = [], 0
        out.append(text)
        size += len(text or "")
    if out:
        yield out


def score_quality(docs: DataFrame, machine: Machine, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """The columns keep, then score and predicted. One Arrow pass without a shuffle; the model is a bounded broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    chosen = docs.select(F.col("text").alias("_text"), *keep)
    schema = chosen.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.value.settings)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = np.concatenate([model.value.scores(*features.batch(texts)) for texts in portions(part.column(0).to_pylist())])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return chosen.mapInArrow(score, schema)


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_quality(documents, train(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
