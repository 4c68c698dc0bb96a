"""BPE encoding by speculation and verification, and decoding.

A greedy longest match proposes tokens for each new word. A sequence of tokens is what the merges give exactly when every two
neighbours, joined, encode to themselves; so all adjacent pairs of a batch are tested together against the pairs already judged, new
pairs are judged once, and only words with a failing pair are merged step by step.

Cases: null and empty texts have no token; very long texts, and words of any length, are encoded whole; repeated rows get equal results;
null and repeated ids are passed on; an empty table gives no row; extra columns, whatever their names, are ignored. The strings of
the vocabulary's special tokens are single tokens, as the tokenizers library has it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# White space as the vocabulary's own patterns mean it.
WHITE = r"\t-\r \x85\xa0  -     　"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"
END = "</w>"
CACHE_WORDS = 250_000
CACHE_PAIRS = 2_000_000
#: Texts whose new words are encoded together.
STEP = 256
#: Longer words are encoded one by one, with a heap: steps over many words at once take as many rounds as the longest has tokens.
LONG_WORD = 256


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if it is visible, else the next one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


# Where versions of Unicode differ on letters, digits, lower case or the order of marks: rarely used places of the first plane,
# and all later planes but for symbols and pictures. Texts with such characters are lower-cased and split by the tokenizers library itself.
RARE = (
    "\u0530\u0557-\u0560\u0588-\u058f\u07fd\u0870-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0c50-\u0c5f\u0cd0-\u0cdf\u0d3b\u0d3c\u0eba\u1715"
    "\u1abf-\u1ace\u1c80-\u1c8f\u1df6-\u1dfa\u2080-\u209f\ua7c0-\ua7ff\ua82c\uab60-\uab6f\U00010000-\U0001efff\U00020000-\U0010ffff"
)


def beyond_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


class Lookup:
    """Integer keys to integer values, for whole arrays at once; -1 for keys that are not there."""

    def __init__(self, keys: list[int], values: list[int]) -> None:
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], -1)


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, then the same of the next, and so on."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


class WordBpe:
    """Encoder for a vocabulary of words with end marks (lower case, white space dropped).

    Words are arrays of symbols: their bytes, the last plus 256. All steps work on the words of a batch together.
    """

    def __init__(self, definition: bytes) -> None:
        parsed = json.loads(definition)
        vocabulary: dict[str, int] = parsed["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parsed["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.token_of = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.stride = max(self.token_of) + 2
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.base = np.array([vocabulary[c] for c in byte_alphabet()] + [vocabulary[c + END] for c in byte_alphabet()], np.int64)
        self.pair_rank = Lookup([vocabulary[a] * self.stride + vocabulary[b] for a, b in merges], list(range(len(merges))))
        self.merged_ids = [vocabulary[a + b] for a, b in merges]
        self.merged_id = np.array(self.merged_ids, np.int64)
        self.ranks = {vocabulary[a] * self.stride + vocabulary[b]: i for i, (a, b) in enumerate(merges)}
        self.symbols_of: list[list[int]] = [[] for _ in range(self.stride)]
        children: dict[int, int] = {}
        accepts = [-1]
        for token, i in vocabulary.items():
            own = [byte_of[c] for c in token.removesuffix(END)]
            if token.endswith(END):
                own[-1] += 256
            self.symbols_of[i], node = own, 0
            for s in own:
                if (node := children.setdefault(node * 512 + s, len(accepts))) == len(accepts):
                    accepts.append(-1)
            accepts[node] = i
        self.children, self.accepted = children, accepts
        self.child, self.accepts = Lookup(list(children), list(children.values())), np.array(accepts, np.int64)
        self.splitter = regex.compile(WORD_PATTERN)
        self.rare = regex.compile(f"[{RARE}]")
        self.definition, self.library, self.byte_of = definition, None, byte_of
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)  # judged pairs in order, and the verdicts
        self.ids_of: dict[str, str] = {}
        self.names_of: dict[str, str] = {}
        self._forget()
        self.speculated = self.merged = 0

    def merge(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words: in each round every word joins its lowest-ranked adjacent pair, the leftmost of equal ones."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.repeat(np.arange(len(lengths)), lengths)
        while len(tokens):
            ranks = np.full(len(tokens), 1 << 40)
            inside = np.flatnonzero(word[:-1] == word[1:])
            found = self.pair_rank(tokens[inside] * self.stride + tokens[inside + 1])
            ranks[inside] = np.where(found < 0, 1 << 40, found)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(word))))
            over = least == 1 << 40
            if over.any():
                done.append((word[over], tokens[over]))
                stay = ~over
                tokens, word, ranks, least = tokens[stay], word[stay], ranks[stay], least[stay]
            at = np.flatnonzero(ranks == least)
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])] if len(at) else at
            tokens[at] = self.merged_id[ranks[at]]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, word = tokens[keep], word[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
        word, tokens = np.concatenate([w for w, _ in done]), np.concatenate([t for _, t in done])
        return tokens[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))

    def propose(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match from the left, for all words at once, by walking a trie of the vocabulary."""
        end = np.cumsum(lengths)
        at, active, words, tokens = end - lengths, np.flatnonzero(lengths), [], []
        while len(active):
            node, pos, live = np.zeros(len(active), np.int64), at[active].copy(), np.arange(len(active))
            best, best_end = np.full(len(active), -1), pos.copy()
            while len(live):
                live = live[pos[live] < end[active[live]]]
                after = self.child(node[live] * 512 + symbols[pos[live]])
                live, after = live[after >= 0], after[after >= 0]
                node[live] = after
                pos[live] += 1
                hit = live[self.accepts[after] >= 0]
                best[hit], best_end[hit] = self.accepts[node[hit]], pos[hit]
            words.append(active)
            tokens.append(best)
            at[active] = best_end
            active = active[best_end < end[active]]
        word = np.concatenate(words)
        return np.concatenate(tokens)[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))

    def merge_long(self, tokens: list[int]) -> list[int]:
        """As merge, for one word: a heap of pairs over a linked list, so that its time goes with n log n."""
        ranks, stride, made = self.ranks, self.stride, self.merged_ids
        following, before = [*range(1, len(tokens)), -1], list(range(-1, len(tokens) - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (r := ranks.get(a * stride + b)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = following[i]
            if tokens[i] < 0 or j < 0 or ranks.get(tokens[i] * stride + tokens[j]) != rank:
                continue  # one of the two has been merged since
            tokens[i], tokens[j] = made[rank], -1
            following[i] = k = following[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(tokens[i] * stride + tokens[k])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(tokens[h] * stride + tokens[i])) is not None:
                heappush(heap, (r, h))
        return [t for t in tokens if t >= 0]

    def propose_long(self, symbols: list[int]) -> list[int]:
        """As propose, for one word."""
        out, at, n, child = [], 0, len(symbols), self.children
        while at < n:
            node, pos, best, end = 0, at, -1, at
            while pos < n and (node := child.get(node * 512 + symbols[pos])) is not None:
                pos += 1
                if self.accepted[node] >= 0:
                    best, end = self.accepted[node], pos
            out.append(best)
            at = end
        return out

    def encode_long(self, word: str) -> list[int]:
        symbols = list(word.encode())
        symbols[-1] += 256
        self.speculated += 1
        tokens = np.array(self.propose_long(symbols), np.int64)
        if self._judge(np.concatenate([[self.stride - 1], tokens[:-1]]) * self.stride + tokens).all():
            return tokens.tolist()
        self.merged += 1
        return self.merge_long(self.base[symbols].tolist())

    def _forget(self) -> None:
        self.ids_of = {t: str(i) for t, i in self.special.items()}
        self.names_of = {t: t for t in self.special}

    def _verdicts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code has been judged, and how."""
        if not len(self.pairs):
            return np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        known = self.pairs[at] == codes
        return known, known & self.pair_ok[at]

    def _judge(self, codes: np.ndarray) -> np.ndarray:
        """True for each pair code that encodes to itself; a token alone is coded as the pair of stride - 1 and it."""
        known, good = self._verdicts(codes)
        if known.all():
            return good
        new = np.unique(codes[~known])
        left, right = np.divmod(new, self.stride)
        parts = [self.symbols_of[a] + self.symbols_of[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
        tokens, lengths = self.merge(self.base[np.array([s for p in parts for s in p], np.int64)], np.array([len(p) for p in parts]))
        last = np.cumsum(lengths) - 1
        alone = left == self.stride - 1
        ok = (lengths == np.where(alone, 1, 2)) & (tokens[last] == right) & (alone | (tokens[last - 1] == left))
        if len(self.pairs) + len(new) > CACHE_PAIRS:
            self.pairs, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
        merged = np.concatenate([self.pairs, new])
        order = np.argsort(merged, kind="stable")
        self.pairs, self.pair_ok = merged[order], np.concatenate([self.pair_ok, ok])[order]
        late = np.flatnonzero(~known)
        good[late] = ok[np.searchsorted(new, codes[late])]
        return good

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[np.cumsum(lengths) - 1] += 256
        tokens, counts = self.propose(symbols, lengths)
        first = np.cumsum(counts) - counts
        left = np.concatenate([[0], tokens[:-1]])
        left[first] = self.stride - 1
        fails = np.flatnonzero(np.logical_or.reduceat(~self._judge(left * self.stride + tokens), first))
        self.speculated += len(words)
        self.merged += len(fails)
        if not len(fails):
            return tokens, counts
        exact, exact_counts = self.merge(self.base[symbols[spans(lengths[fails], (np.cumsum(lengths) - lengths)[fails])]], lengths[fails])
        kept = np.ones(len(words), bool)
        kept[fails] = False
        owner = np.concatenate([np.repeat(np.arange(len(words)), counts)[np.repeat(kept, counts)], np.repeat(fails, exact_counts)])
        tokens = np.concatenate([tokens[np.repeat(kept, counts)], exact])
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _learn(self, words: set[str]) -> None:
        if len(self.ids_of) + len(words) > CACHE_WORDS:
            self._forget()
        for word in [w for w in words if len(w) > LONG_WORD]:
            tokens = self.encode_long(word)
            self.ids_of[word], self.names_of[word] = " ".join(map(str, tokens)), " ".join(map(self.token_of.__getitem__, tokens))
        new = [w for w in words if len(w) <= LONG_WORD]
        if not new:
            return
        tokens, counts = self.encode_words(new)
        ids, names = list(map(str, tokens.tolist())), list(map(self.token_of.__getitem__, tokens.tolist()))
        at = 0
        for word, n in zip(new, counts.tolist(), strict=True):
            self.ids_of[word] = ids[at] if n == 1 else " ".join(ids[at : at + n])
            self.names_of[word] = names[at] if n == 1 else " ".join(names[at : at + n])
            at += n

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if self.specials is not None and self.specials.search(text):
            out = []
            for i, part in enumerate(self.specials.split(text)):
                out += [part] if i % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.splitter.findall(text.lower())
        if beyond_latin(text) and self.rare.search(text):
            return self._library_words(text)
        return self.splitter.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _library_words(self, text: str) -> list[str]:
        if self.library is None:
            self.library = Tokenizer.from_str(self.definition.decode())
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, part)).decode() for part, _ in parts]

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, the ids and the tokens' strings (each joined by spaces) of every text."""
        for at in range(0, len(texts), STEP):
            split = [self.pieces(t) if t else [] for t in texts[at : at + STEP]]
            if new := set().union(*split).difference(self.ids_of):
                self._learn(new)
            for words in split:
                try:
                    ids = " ".join(map(self.ids_of.__getitem__, words))
                except KeyError:  # the store was emptied meanwhile
                    self._learn(set(words).difference(self.ids_of))
                    if any(w not in self.ids_of for w in words):
                        self._learn(set(words).difference(self.special))
                    ids = " ".join(map(self.ids_of.__getitem__, words))
                yield ids.count(" ") + 1 if words else 0, ids, " ".join(map(self.names_of.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in next(self.encode_batch([text]))[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special ones included: the vocabulary file names no decoder."""
        return " ".join(self.token_of[i] for i in ids)


_LOADED: dict[int, tuple[bytes, WordBpe]] = {}


def _encoder(definition: bytes) -> WordBpe:
    """One encoder for a worker process: its stores of words and pairs serve all its tasks."""
    key = hash(definition)
    if key not in _LOADED or _LOADED[key][0] != definition:
        _LOADED.clear()
        _LOADED[key] = definition, WordBpe(definition)
    return _LOADED[key][1]


def encode_texts(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids (array, null if not with_ids), ids_text, decoded: one Arrow pass without a shuffle.

    The vocabulary file (1 to 3 MB) is read on the driver and broadcast, so executors need no copy of it.
    """
    with open(vocabulary_path, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    key_type = chosen.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids", "ids_text", "decoded"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = list(encoder.encode_batch(part.column(1).to_pylist()))
                ids = [[int(i) for i in r[1].split()] for r in rows] if with_ids else [None] * len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names)

    return chosen.mapInArrow(encode, f"doc_id {key_type}, n_tokens long, ids array<int>, ids_text string, decoded string")


def encoded_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_texts gives.

    They are taken where ids and tokens are made: sent to the JVM, those strings would be three times as large as the texts.
    """
    with open(vocabulary_path, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    chosen = docs.select("doc_id", "text")
    key_type = chosen.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [(n, digest(ids), digest(decoded)) for n, ids, decoded in encoder.encode_batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return chosen.mapInArrow(work, f"doc_id {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
