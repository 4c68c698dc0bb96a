"""Packing token sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows, which need no search. The rests go, longest first, into the open
window that leaves the least room; a segment tree over remaining capacities finds it. Rests are dealt evenly into groups of about
group_tokens tokens, each packed by one task, so the work of a task is bounded at every size and at most one poorly filled window a
group is left.

Cases: a null or empty text is the end id alone; very long texts are cut into full windows; repeated rows, and rows that share an id or
have none, are packed separately; an empty table gives no piece; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkloom.llm.bpe import byte_alphabet
from chunkloom.llm.common import cut

WINDOW = 2048
END_ID = 1
GROUP_TOKENS = 1 << 20
# Fixed value: how a byte-level vocabulary splits text before its merges.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = 100_000
_LONG_RUN = re.compile(r"\s{%d}" % LONG_SPACE)


class ByteTokens:
    """Ids of texts as little-endian unsigned 32-bit integers, for a byte-level vocabulary file of the tokenizers library.

    Where the file's merges stand in the order of their ids, as they do in the public ones, the ids are also what tiktoken gives with the
    same tokens as ranks, at a quarter of the time; any other file goes through the tokenizers library itself, and so does a text with a
    run of LONG_SPACE or more characters of white space (at a million of them the pattern of tiktoken fails).
    """

    def __init__(self, definition: bytes) -> None:
        parsed = json.loads(definition)
        vocabulary, merges = parsed["model"]["vocab"], parsed["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        made = [vocabulary[a + b] for a, b in pairs]
        splitter = parsed["pre_tokenizer"] or {}
        ranked = made == sorted(made) and len(vocabulary) == 256 + len(made) and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space") and not parsed["normalizer"]
        if ranked:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
            encoding = tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._plain = lambda text: encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes() if len(text) < LONG_SPACE or not _LONG_RUN.search(text) else self._library(text)
        else:
            self._plain = self._library
        self.definition, self.tokenizer = definition, None
        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def _library(self, text: str) -> bytes:
        if self.tokenizer is None:
            self.tokenizer = Tokenizer.from_str(self.definition.decode())
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.specials is not None and self.specials.search(text):
            return b"".join(self.special[part] if i % 2 else self._plain(part) for i, part in enumerate(self.specials.split(text)))
        return self._plain(text)


_LOADED: dict[int, tuple[bytes, ByteTokens]] = {}


def _tokens(definition: bytes) -> ByteTokens:
    """One encoder for a worker process."""
    key = hash(definition)
    if key not in _LOADED or _LOADED[key][0] != definition:
        _LOADED.clear()
        _LOADED[key] = definition, ByteTokens(definition)
    return _LOADED[key][1]


class OpenWindows:
    """A segment tree over remaining capacities 0..window: which have an open window."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        at = capacity + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, window) with the smallest capacity of at least size; None if there is none."""
        at, tree = size + self.leaves, self.any
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.stacks[capacity].pop()
        if not self.stacks[capacity]:
            tree[at] = 0
            while at > 1 and not (tree[at] or tree[at ^ 1]):
                at >>= 1
                tree[at] = 0
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1..window)."""
    where, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, fresh = OpenWindows(window), counter()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        capacity, number = free.take(size) or (window, next(fresh))
        where[i], offsets[i] = number, window - capacity
        if capacity > size:
            free.put(capacity - size, number)
    return where, offsets


PIECE = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, number long"


def tokenised_pieces(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, number (unique) of each full window and rest; ids are not kept."""
    with open(vocabulary_path, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen = docs.select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = _tokens(definition.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (tokens.ids(text) if text else b"") + end
                n = len(raw) // 4
                for start in range(0, n, window):
                    rows.append(i)
                    out.append((start, min(window, n - start), zlib.crc32(raw[4 * start : 4 * (start + window)]), n, number))
                    number += 1
            if out:
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names)

    return chosen.mapInArrow(cut_up, PIECE.format(key=chosen.schema["doc_id"].dataType.simpleString()))


def pack_pieces(pieces: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (with a unique number and a length of at most window).

    Full windows get theirs where they are. Only the rests are shuffled, without texts or ids, and dealt by number, which no hot key can
    skew.
    """
    rests = pieces.where(F.col("length") < window)
    total = rests.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    full = pieces.where(F.col("length") >= window).select("*", (F.col("number") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def pack(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number", kind="stable")
        where, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns="_group").assign(sequence_id=((int(group[0]) << 32) + where) * 2 + 1, offset=offsets)

    dealt = rests.withColumn("_group", F.pmod(F.xxhash64("number"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("_group").applyInPandas(pack, full.schema))


def packed(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    pieces = cut(tokenised_pieces(docs, vocabulary_path, window, end_id))
    return pack_pieces(pieces, window, group_tokens).drop("number")
