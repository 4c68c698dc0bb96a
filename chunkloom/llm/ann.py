"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one full-dimensional code word from each codebook. Codebooks start as residual k-means and are then
solved for jointly; codes are found by beam search. Inner products of a query with all code words make a lookup table; the score of a row
is the sum of one entry a codebook (and, for Euclidean distance, the stored norm of its approximation). The best rows of a block are
scored again, exactly and in double precision, on the original vectors.

Cases: vectors that are null, zero, of another than the commonest dimension, or that hold null or non-finite components take no part, nor do
rows without an id; of rows that share an id one is used, that of the least vector, so a query's ids are distinct; rows with the query's own
id are no candidates; ties go to the smaller id, also where equal vectors exceed a shortlist; with fewer candidates than asked for, all are
returned; an empty table gives no row; extra columns, whatever their names, are ignored. Vectors of doubles are scored as doubles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import cut

ROW_BLOCK, QUERY_BLOCK, SCORED = 8192, 2048, 256


@dataclass(frozen=True)
class Settings:
    """max_training_rows bounds the sample that codebooks are fitted on (the first by a hash of the id); every row is indexed."""

    codebooks: int = 16
    words: int = 256
    beam: int = 4
    rounds: int = 6
    max_training_rows: int = 16_384
    rerank_share: float = 0.05
    min_rerank: int = 200
    metric: str = "inner"
    seed: int = 6


@dataclass
class Quantiser:
    """codebooks x words x dimension floats: 1 MB with 16 x 256 x 64."""

    books: np.ndarray
    beam: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by beam search: after each codebook the `beam` sums nearest to the vector go on."""
        count, words, _ = self.books.shape
        norms = (self.books**2).sum(2)
        out = np.empty((len(x), count), np.uint8)
        for at in range(0, len(x), 512):
            rest = x[at : at + 512, None, :]
            n = len(rest)
            codes = np.zeros((n, 1, 0), np.uint8)
            for m in range(count):
                errors = (rest**2).sum(2)[:, :, None] + norms[m] - 2 * (rest @ self.books[m].T)
                flat = errors.reshape(n, -1)
                keep = min(self.beam if m + 1 < count else 1, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                source, word = np.divmod(best, words)
                rows = np.arange(n)[:, None]
                rest = rest[rows, source] - self.books[m][word]
                codes = np.concatenate([codes[rows, source], word[:, :, None].astype(np.uint8)], axis=2)
            out[at : at + n] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def solve(self, x: np.ndarray, codes: np.ndarray) -> None:
        """All code words at once by least squares, drawn a little to where they are."""
        count, words, dimension = self.books.shape
        places = codes.astype(np.int64) + np.arange(count) * words
        gram, right = np.zeros((count * words, count * words)), np.zeros((count * words, dimension))
        for m in range(count):
            np.add.at(right, places[:, m], x)
            for k in range(count):
                gram[m * words : (m + 1) * words, k * words : (k + 1) * words] = np.bincount(codes[:, m].astype(np.int64) * words + codes[:, k], minlength=words * words).reshape(words, words)
        pull = 2.0
        old = self.books.reshape(-1, dimension).astype(np.float64)
        gram[np.diag_indices_from(gram)] += pull
        self.books = np.linalg.solve(gram, right + pull * old).reshape(self.books.shape).astype(np.float32)


def train(x: np.ndarray, settings: Settings) -> Quantiser:
    random = np.random.default_rng(settings.seed)
    words = min(settings.words, len(x))
    rest, books = x.astype(np.float32).copy(), []
    for _ in range(settings.codebooks):
        book = rest[random.choice(len(rest), words, replace=False)].copy()
        for _ in range(settings.rounds):
            nearest = ((book**2).sum(1) - 2 * (rest @ book.T)).argmin(1)
            sums = np.zeros_like(book)
            np.add.at(sums, nearest, rest)
            held = np.bincount(nearest, minlength=words)
            book[held > 0] = sums[held > 0] / held[held > 0, None]
        nearest = ((book**2).sum(1) - 2 * (rest @ book.T)).argmin(1)
        rest -= book[nearest]
        books.append(book)
    quantiser = Quantiser(np.stack(books), settings.beam)
    quantiser.solve(x, quantiser.encode(x.astype(np.float32)))
    return quantiser


def _valid(column: str, dimension: int) -> Column:
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(column) == dimension) & finite & F.exists(column, lambda v: v != 0)


def shortlist(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k best scores of each row; of those that tie with the last, the first ones. Scores of -inf never count."""
    if k >= scores.shape[1]:
        return [np.flatnonzero(s > -np.inf) for s in scores]
    out, least = [], -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    for s, limit in zip(scores, least):
        above, ties = np.flatnonzero(s > limit), np.flatnonzero(s == limit) if limit > -np.inf else np.empty(0, np.int64)
        out.append(np.concatenate([above, ties[: k - len(above)]]))
    return out


def scan_block(books: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, settings: Settings, scale: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query_id, vec_id, score) of the best k rows of a block for each query: tables for a shortlist, exact scores for the order.

    vectors and queries are the original ones; ids ascend.
    """
    count, words, _ = books.shape
    short = min(len(ids), max(settings.min_rerank, k + 1, int(settings.rerank_share * len(ids))))
    exact_rows = vectors.astype(np.float64)
    for at in range(0, len(queries), SCORED):
        q, q_ids = queries[at : at + SCORED], query_ids[at : at + SCORED]
        table = ((q * scale).astype(np.float32) @ books.reshape(count * words, -1).T).reshape(len(q), count, words)
        scores = np.zeros((len(q), len(ids)), np.float32)
        for m in range(count):
            scores += np.take(table[:, m], codes[:, m], axis=1)
        if settings.metric == "euclidean":
            scores = 2 * scores - norms
        low, high = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
        for i in np.flatnonzero(high > low):
            scores[i, low[i] : high[i]] = -np.inf
        picked = shortlist(scores, short)
        wide = q.astype(np.float64)
        for i in range(len(q)):
            rows = picked[i]
            if settings.metric == "euclidean":
                exact = -np.sqrt(((exact_rows[rows] - wide[i]) ** 2).sum(1))
            else:
                exact = (exact_rows[rows] * wide[i]).sum(1)
            best = np.lexsort((ids[rows], -exact))[:k]
            yield np.full(len(best), q_ids[i]), ids[rows[best]], exact[best]


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v, q), of each id that occurs more than once only the row of the least vector. Only such ids' vectors are shuffled."""
    shared = cut(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if shared.isEmpty():
        return rows
    several = rows.join(shared, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    return cut(rows.join(shared, "vec_id", "left_anti").unionByName(several))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query among all other rows.

    Blocks of queries meet blocks of rows through an equi-join on block numbers; a block is a few MB whatever the table holds. Only k rows
    a query and block leave a task. Work grows as queries times rows, at one table entry a codebook.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    kind = "float" if vectors.select(vector).schema[0].dataType.simpleString() == "array<float>" else "double"
    width = np.dtype(np.float32 if kind == "float" else np.float64)
    chosen = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"), is_query.alias("q")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    common = chosen.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], result)
    dimension = common.d
    valid = one_row_an_id(chosen.where(_valid("v", dimension)))
    sizes = valid.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    if not sizes.n or not sizes.q:
        return spark.createDataFrame([], result)
    # the index works in floats: components that would leave their range are scaled there, exact scores are of the originals
    scale = 1.0 if 1e-9 < sizes.most < 1e9 else 1.0 / sizes.most
    sample = valid.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(settings.max_training_rows).select("v").collect()
    quantiser = spark.sparkContext.broadcast(train((np.array([r.v for r in sample], np.float64) * scale).astype(np.float32), settings))
    row_salts, query_blocks = max(1, -(-sizes.n // ROW_BLOCK)), max(1, -(-sizes.q // QUERY_BLOCK))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], part.column(1).flatten().to_numpy(zero_copy_only=False).astype(width).reshape(-1, dimension)[order]
                codes = quantiser.value.encode((x * scale).astype(np.float32))
                norms = (quantiser.value.decode(codes) ** 2).sum(1).astype(np.float32)
                data = [[a.tobytes()] for a in (ids, x, codes, norms)]
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(data[0][0]) % row_salts], pa.int32()), *(pa.array(d, pa.binary()) for d in data)], ["salt", "ids", "x", "codes", "norms"])

    index = cut(valid.select("vec_id", "v").mapInArrow(encode, "salt int, ids binary, x binary, codes binary, norms binary"))
    blocks = valid.where("q").groupBy(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(query_blocks)).cast("int").alias("block"))
    asked = blocks.agg(F.collect_list("vec_id").alias("qids"), F.flatten(F.collect_list("v")).alias("qv"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(row_salts - 1))))
    met = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(asked, ["block", "salt"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(c)[i].as_buffer() for c in range(4)]
                ids = np.frombuffer(raw[0], np.int64)
                x = np.frombuffer(raw[1], width).reshape(len(ids), dimension)
                codes, norms = np.frombuffer(raw[2], np.uint8).reshape(len(ids), -1), np.frombuffer(raw[3], np.float32)
                q_ids = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                queries = batch.column(5)[i].values.to_numpy(zero_copy_only=False).astype(width).reshape(-1, dimension)
                found = list(scan_block(quantiser.value.books, ids, x, codes, norms, q_ids, queries, k, settings, scale))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    best = met.select("ids", "x", "codes", "norms", "qids", "qv").mapInArrow(scan, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
