import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkloom.llm import bpe, common, fingerprints, packing, queries, sharding, simhash, suffix_dedup, url_filter
from tests.llm.conftest import sentence

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def clashing(df):
    """Extra columns named like the operators' own."""
    names = "n_bytes spans kept doc digest bucket guest group size salt shard slot node root a b fp check score predicted clauses y number start length offset rule verdict place _doc".split()
    return df.withColumns({n: F.lit("x") for n in names})


# --- rows held at once ---


SMALL_BATCHES = ["op1_suffix_dedup", "op3_quality"]


def most_rows_in_a_batch(spark):
    """Of 2,000 rows in one partition that are passed to Python."""
    counts = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["rows"]) for b in batches)
    return max(r.rows for r in spark.range(0, 2000, 1, 1).mapInArrow(counts, "rows long").collect())


@pytest.mark.parametrize("name", SMALL_BATCHES)
def test_whole_texts_pass_in_small_batches(spark, sf_dir, name):
    own = queries.queries()[name](spark, sf_dir).sparkSession
    assert most_rows_in_a_batch(own) == common.ROWS_AT_ONCE and most_rows_in_a_batch(spark) == 2000
    assert int(own.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.ROWS_AT_ONCE


def test_small_batches_keep_other_settings(spark):
    keys = {"spark.sql.shuffle.partitions": "7", "spark.hadoop.some.store": "x", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        own = common.in_small_batches(spark)
        assert {k: own.conf.get(k) for k in keys} == keys and most_rows_in_a_batch(own) == 50
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")  # no bound
        assert most_rows_in_a_batch(common.in_small_batches(spark)) == common.ROWS_AT_ONCE
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


# --- suffix array ---


def brute_repeats(rows, length):
    """(removed bytes, runs, kept) of each row by remembering every string in order."""
    order = sorted({(i if i is not None else 1 << 63, xxhash64(t), t or "") for i, t, *_ in rows})
    seen, masks = set(), {}
    for i, h, t in order:
        raw = t.encode()
        mask, new = bytearray(len(raw)), set()
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                mask[s : s + length] = b"\1" * length
            seen.add(w)
        masks[i, t] = mask
        del new
    return masks


def xxhash64(text):
    unsigned = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


@pytest.mark.parametrize("length", [40, 100])
def test_repeats_match_brute_force(spark, docs, docs_rows, length):
    masks = brute_repeats(docs_rows, length)
    assert sum(map(sum, masks.values())) > 500
    for r in suffix_dedup.without_repeats(clashing(docs), length=length).collect():
        mask, raw = masks[r.doc_id, r.text], r.text.encode()
        assert bytes(r.kept) == bytes(x for x, m in zip(raw, mask) if not m)
        assert sum(s.end - s.start for s in r.spans) == sum(mask) and r.n_bytes == len(raw)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_of_awkward_rows(spark, awkward, empty):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.repeat_digests(awkward).collect()}
    assert suffix_dedup.repeat_digests(awkward).count() == awkward.count() and suffix_dedup.repeat_digests(empty).count() == 0
    long = next(n for i, n in got if i == 4)
    assert got[4, long].n_removed == 0 and got[5, long].n_removed == long and got[5, long].n_spans == 1
    assert got[1, 0].n_removed == 0 and got[1, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[9, 5000].n_removed == 4999  # from its second byte on, each string started one byte earlier
    assert got[7, 260].n_removed > 0


def test_repeats_with_frequent_leading_strings(spark, monkeypatch):
    """Splitters that equal one string send it to several buckets and through the second round."""
    r = random.Random(4)
    passage = " ".join(r.choice(["ab", "cde", "f", "ghij"]) for _ in range(60))
    rows = [(i, "".join(r.choice("klmnop ") for _ in range(20)) + passage + "".join(r.choice("qrstuv ") for _ in range(20)), "", "", 0) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    monkeypatch.setattr(suffix_dedup, "shuffle_width", lambda _: 64)
    masks = brute_repeats(rows, 100)
    for x in suffix_dedup.without_repeats(frame).collect():
        assert sum(s.end - s.start for s in x.spans) == sum(masks[x.doc_id, x.text])


def test_repeats_with_a_frequent_opening(spark, monkeypatch):
    """One opening in every text, unlike continuations: its suffixes are dealt by all that their windows share. Buckets exceed splitters."""
    r = random.Random(14)
    opening = "all of these texts open with one and the same rather long line: "
    tails = ["".join(r.choice("abcdef ") for _ in range(90)) for _ in range(30)]
    rows = [(i, opening + r.choice(tails)[: r.randrange(20, 90)] + "".join(r.choice("uvwxyz ") for _ in range(70)), "", "", 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    monkeypatch.setattr(suffix_dedup, "shuffle_width", lambda _: 96)
    monkeypatch.setattr(suffix_dedup, "MAX_SPLITTERS", 48)
    masks = brute_repeats(rows, 100)
    assert sum(map(sum, masks.values())) > 2000
    for x in suffix_dedup.without_repeats(frame).collect():
        assert sum(s.end - s.start for s in x.spans) == sum(masks[x.doc_id, x.text])


@pytest.mark.parametrize("most", [0, 100])
def test_repeats_of_rows_without_or_with_one_id(spark, monkeypatch, most):
    """Rows of null or repeated ids are told apart by 64 bits of their texts' hash, broadcast or on every row."""
    monkeypatch.setattr(suffix_dedup, "MAX_SHARED_IDS", most)
    r = random.Random(15)
    shared = ["".join(r.choice("abcdefgh ") for _ in range(140)) for _ in range(6)]
    text = lambda: "".join(r.choice("stuvwxyz ") for _ in range(r.randrange(5, 80))) + r.choice(["", *shared]) + "".join(r.choice("stuvwxyz ") for _ in range(r.randrange(5, 80)))
    rows = [(r.choice([None, None, 5, 6, i + 10]), text()) for i in range(400)]
    masks = brute_repeats(rows, 100)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(x.doc_id, x.text, sum(s.end - s.start for s in x.spans)) for x in suffix_dedup.without_repeats(frame).collect()]
    assert sorted(got, key=str) == sorted(((i, t, sum(masks[1 << 63 if i is None else i, t])) for i, t in rows), key=str)


def test_long_texts_in_segments(docs_rows, monkeypatch):
    """Segments hold each window once, and give the same suffixes as whole texts."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 150)
    layout = suffix_dedup.Layout(100)
    texts = [t.encode() for _, t, *_ in docs_rows if len(t.encode()) >= 100]
    cut = [(i, base, piece) for i, t in enumerate(texts) for base, piece in suffix_dedup.segments(t, 100)]
    starts = [(i, base + s) for i, base, piece in cut for s in range(len(piece) - 99)]
    assert sorted(starts) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)] and len(cut) > len(texts)
    n = len(cut)
    got = suffix_dedup.suffixes_of([p for *_, p in cut], np.array([i for i, *_ in cut]), np.zeros(n, np.int64), np.array([b for _, b, _ in cut]), layout)
    whole = suffix_dedup.suffixes_of(texts, np.arange(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), layout)
    windows = lambda s: sorted((int(d), int(f + k), int(b - k)) for d, f, b, w in zip(s.doc, s.first, s.before.astype(int), s.windows) for k in range(w))
    assert windows(got) == windows(whole)


def test_whole_characters(spark):
    text = "ñandú " * 40
    got = suffix_dedup.without_repeats(spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string"), whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in got)


# --- URL filter ---


def test_url_rules_and_terms(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?q=/fr/"), (2, "http://example.com/en/1"), (3, "http://a.example.com/fr/1"), (4, "https://x.net/es/#t"), (5, "https://net/fr/"), (6, "https://x.net/en/"),
        (7, "http://casino-win.example.org/en/1"), (8, "http://casinos.org/"), (9, "http://free-bets.org"), (10, "http://free-thing.org/free"), (11, None), (12, "no scheme com/"), (13, "http://com"), (14, "http://adult-x.org/"), (15, "http://notcom/"), (16, ""),
    ]
    frame = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(frame).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("com/", "allow")
    assert got[4] == ("x.net", "/es/", "net/es/", "block") and got[5][2] == "net/fr/" and got[6][2:] == (None, "allow")
    assert [got[i][3] for i in (7, 8, 9, 10, 14, 15)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert got[11] == got[12] == got[16] == ("", "", None, "allow") and got[13] == ("com", "", None, "allow")


def test_queries_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df, expected = queries.queries()[name](spark, sf_dir), con.sql(sql)
        at = [expected.columns.index(c) for c in df.columns]
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in expected.fetchall())


# --- sharding ---


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, n, x = (low + high) // 2, 1, 0
        for s in sizes:
            if x + s > middle:
                n, x = n + 1, 0
            x += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [3, 7, 40])
def test_shards_are_minimax_and_whole(spark, docs, docs_rows, shards):
    rows = sharding.shard_documents(clashing(docs), shards).collect()
    text = {i: t for i, t, *_ in docs_rows}
    groups, totals, slots = defaultdict(int), defaultdict(int), defaultdict(list)
    where = {}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert where.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < shards
        groups[raw] += r.size
        totals[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(docs_rows)
    left, sizes = shards, sorted(groups.values(), reverse=True)
    total = sum(sizes)
    alone = 0
    while left > 1 and sizes[alone] * left >= total:
        total, left, alone = total - sizes[alone], left - 1, alone + 1
    own = sorted(groups, key=lambda g: (-groups[g], hashlib.sha256(g).digest()))[:alone]
    rest = [groups[g] for g in sorted(groups, key=lambda g: hashlib.sha256(g).digest()) if g not in own]
    assert max(totals.values()) == max([brute_capacity(rest, left)] + [groups[g] for g in own])


def test_capacity_search_agrees_with_plain_search():
    r = random.Random(2)
    for _ in range(30):
        sizes = [r.randrange(1, 500) for _ in range(r.randrange(1, 80))]
        ends = list(np.cumsum(sizes))
        cells = [sharding.Cell(i, 60, int(e), i + 1, 1) for i, e in enumerate(ends)]
        k = r.randrange(1, 10)
        capacity = sharding.least_capacity(cells, max(max(sizes), -(-sum(sizes) // k)), k, False)
        cuts = sharding.even_cuts(cells, capacity, k)
        assert capacity == brute_capacity(sizes, k) and cuts[-1] == ends[-1] and max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity


def test_shards_of_awkward_rows(spark, awkward, empty):
    rows = sharding.shard_documents(awkward).collect()
    assert len(rows) == awkward.count() and sharding.shard_documents(empty).count() == 0
    nulls = [r for r in rows if r.size == 16]
    assert len({r.shard for r in nulls}) == 1 and len(nulls) == 3 and {r.text_crc32 for r in nulls} == {0}
    assert len({r.shard for r in rows if r.doc_id in (4, 5)}) == 1


def test_slots_of_rows_without_ids(spark, monkeypatch):
    """Equal texts without an id are dealt to many salts, and each row has a slot of its own."""
    monkeypatch.setattr(sharding, "ROWS_PER_SALT", 4)
    rows = [(None if i % 2 else i, "hot " * 50 if i % 3 == 0 else f"text {i % 7}") for i in range(900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_group_leaves_no_empty_shard(spark):
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {i} " * (1 + i % 9)) for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = sorted(r.s for r in got)
    assert len(sizes) == 40 and sizes[-2] < 1.5 * sizes[0]


# --- fingerprints ---


def test_edits_and_fingerprints(spark, docs, docs_rows):
    got = {r.doc_id: r for r in fingerprints.edit_likeness(clashing(docs)).collect()}
    order = sorted(docs_rows, key=lambda d: -d[0])
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    by_text = defaultdict(set)
    for (i, t, *_), (_, after, *_) in zip(order, [*order[1:], order[0]]):
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == plain[i] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (t == after) or r.near_next > 0.5
        by_text[t].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    longer = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in longer]) > 0.5 > 3 * np.mean([r.near_next for r in longer if r.near_next < 0.5] or [0])


def plain_chunks(text):
    """Chunks by the rule itself, byte by byte: a sum of shifted gear values over 16 bytes, a strict and then an easy limit."""
    raw, out, start = text.encode(), [], 0
    gear = [int(g) for g in np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)]
    while start < len(raw):
        end = start + 1
        while end < len(raw) and end - start < fingerprints.MOST:
            h = sum(gear[raw[k]] << (end - 1 - k) for k in range(max(0, end - 16), end)) & 0xFFFF
            bits = fingerprints.STRICT_BITS if end - start < fingerprints.NORMAL else fingerprints.EASY_BITS
            if end - start >= fingerprints.LEAST and h >> (16 - bits) == 0 and len(raw) - start > fingerprints.LEAST:
                break
            end += 1
        out.append(raw[start:end])
        start = end
    return out


def test_likeness_against_plain_chunks(spark, docs, docs_rows):
    """near_edited and near_next are shares of the bytes of a text's distinct chunks, cut and compared one by one."""
    order = sorted(docs_rows, key=lambda d: -d[0])
    share = lambda a, b: (sum(map(len, set(a) & set(b))) / sum(map(len, set(a)))) if a else float(not b)
    got = {r.doc_id: r for r in fingerprints.edit_likeness(docs).collect()}
    for (i, t, *_), (_, after, *_) in zip(order, [*order[1:], order[0]]):
        own, changed = plain_chunks(t), plain_chunks(fingerprints.edited(t, after))
        assert got[i].near_edited == pytest.approx(share(own, changed), abs=1e-12) and got[i].near_next == pytest.approx(share(own, plain_chunks(after)), abs=1e-12)


def test_order_of_rows_that_share_an_id(spark, monkeypatch):
    """Many rows without an id and of one id, in many ranges: descending id, then the digest of the text."""
    monkeypatch.setattr(fingerprints, "shuffle_width", lambda _: 23)
    r = random.Random(51)
    rows = [(r.choice([None, None, 7, i + 10]), sentence(r, r.randrange(0, 12))) for i in range(300)]
    rows += rows[:5]
    key = lambda d: (d[0] if d[0] is not None else -(1 << 63), xxhash64(d[1]), d[1])
    order = sorted(rows, key=key, reverse=True)
    expected = [(i, len(t), hashlib.sha256(fingerprints.edited(t, after[1]).encode()).hexdigest()) for (i, t), after in zip(order, [*order[1:], order[0]])]
    got = fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in got), key=str) == sorted(expected, key=str)


def test_fingerprints_of_awkward_rows(spark, awkward, empty):
    rows = fingerprints.edit_likeness(awkward).collect()
    assert len(rows) == awkward.count() and fingerprints.edit_likeness(empty).count() == 0
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    one = fingerprints.edit_likeness(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_chunks_resist_shifts_and_keep_bounds():
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh \n") for _ in range(20_000))
    ends = fingerprints.chunk_ends(np.frombuffer(text.encode(), np.uint8))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= fingerprints.MOST and sizes[:-1].min() >= fingerprints.LEAST
    a, b = fingerprints.chunk_codes(text), fingerprints.chunk_codes("inserted " + text[:9000] + "!" + text[9000:])
    assert fingerprints.containment(a, b) > 0.97 and fingerprints.containment(a, a) == 1
    empty = fingerprints.chunk_codes("")
    assert fingerprints.containment(empty, empty) == 1 and fingerprints.containment(empty, a) == fingerprints.containment(a, empty) == 0


# --- BPE and packing ---

ODD = ["", " ", "İstanbul ΑΣ ΟΔΟΣ", "a\x1cb\x85d\xa0e​f　i", "<|endoftext|>x<|startoftext|> <|endoftext", "it's we'LL I'M 'S ''s", "１２３ ½ Ⅷ ²", "日本語 한국어 🙂🙂", "\t\n  \r\n x", "\x00\x01\x7f", "A" * 3000]


def test_bpe_same_as_the_library(spark, docs, docs_rows):
    library = Tokenizer.from_file(WORD)
    texts = [t for _, t, *_ in docs_rows] + ODD
    coder = bpe.WordBpe(open(WORD, "rb").read())
    for text, (n, ids, decoded) in zip(texts, coder.encode_batch(texts)):
        e = library.encode(text, add_special_tokens=False)
        assert (n, ids, decoded) == (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))
        assert coder.decode(coder.encode(text)) == decoded
    assert 0 < coder.merged < coder.speculated
    got = {r.doc_id: r for r in bpe.encoded_digests(clashing(docs), WORD).collect()}
    for i, t, *_ in docs_rows:
        e = library.encode(t, add_special_tokens=False)
        assert got[i].ids_sha256 == bpe.digest(" ".join(map(str, e.ids))) and got[i].decoded_sha256 == bpe.digest(library.decode(e.ids, skip_special_tokens=False))


def test_bpe_of_rare_characters_same_as_the_library():
    """Each character of the first plane up to U+33FF and of the rare places, beside a letter, digit, sign and space; then random strings."""
    library, coder, r = Tokenizer.from_file(WORD), bpe.WordBpe(open(WORD, "rb").read()), random.Random(41)
    points = [*range(1, 0x3400), *range(0xA000, 0xABF0, 3), *range(0xA7C0, 0xA800), *range(0xF900, 0x12700), *range(0x16E00, 0x17000), *range(0x1F000, 0x1FC00, 5)]
    texts = ["\n".join(f"a{chr(c)}b{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}a {chr(c)}1 {chr(c)}!x" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    planes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(r.choice(p)) if r.random() < 0.7 else r.choice("aB1 !\n.é") for _ in range(30)) for p in (planes, planes[:0xD000]) for _ in range(3000)]
    assert [[int(i) for i in ids.split()] for _, ids, _ in coder.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_of_very_long_words():
    library, coder, r = Tokenizer.from_file(WORD), bpe.WordBpe(open(WORD, "rb").read()), random.Random(42)
    texts = ["".join(r.choices(letters, k=n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "éñü", "!?.") for n in (255, 256, 257, 700, 20_000)] + ["a" * 100_000]
    assert [coder.encode(t) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_with_small_stores(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 50)
    library, coder = Tokenizer.from_file(WORD), bpe.WordBpe(open(WORD, "rb").read())
    texts = [" ".join(f"{w}{i}" for w in ("gorblatz", "unquefaction", "ñandúes")) for i in range(40)]
    assert [[int(i) for i in ids.split()] for _, ids, _ in coder.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_of_awkward_rows(spark, awkward, empty):
    rows = bpe.encode_texts(awkward, WORD).collect()
    assert len(rows) == awkward.count() and all(r.n_tokens == len(r.ids) for r in rows) and bpe.encode_texts(empty, WORD).count() == 0


def test_byte_tokens_same_as_the_library():
    library, coder = Tokenizer.from_file(BYTE), packing.ByteTokens(open(BYTE, "rb").read())
    for text in ODD:
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_byte_tokens_of_long_white_space_same_as_the_library():
    library, coder = Tokenizer.from_file(BYTE), packing.ByteTokens(open(BYTE, "rb").read())
    for text in (" " * 99_999 + "x", "a" + " " * 100_000 + "b", "a" + "\n" * 1_100_000, " \t" * 600_000 + "y"):
        assert coder.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_decreasing_matches_a_plain_search():
    r = random.Random(6)
    for _ in range(20):
        lengths = np.array([r.randrange(1, 65) for _ in range(r.randrange(1, 200))])
        where, offsets = packing.best_fit_decreasing(lengths, 64)
        open_, plain = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            fits = [w for w in range(len(open_)) if open_[w] >= lengths[i]]
            w = min(fits, key=lambda w: open_[w], default=len(open_))
            if w == len(open_):
                open_.append(64)
            plain[i] = open_[w]
            open_[w] -= lengths[i]
        assert sorted(np.bincount(where, lengths)) == sorted(64 - x for x in open_)
        assert all(64 - plain[i] == offsets[i] for i in range(len(lengths)))


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_packed_pieces_cover_everything(spark, which, request, empty):
    frame = request.getfixturevalue(which)
    library = Tokenizer.from_file(BYTE)
    rows = packing.packed(clashing(frame), BYTE, window=64 if which == "docs" else 2048, group_tokens=2000).collect()
    limit = 64 if which == "docs" else 2048
    ids = defaultdict(list)
    for d in frame.collect():
        ids[d.doc_id].append(np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4"))
    held, placed = defaultdict(list), defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
        held[r.doc_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert {d: sum(r.length for r in rs) for d, rs in held.items()} == {d: sum(map(len, xs)) for d, xs in ids.items()}
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert packing.packed(empty, BYTE).count() == 0


# --- SimHash ---


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> j & 1 for s in shingles) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(shingles))


def plain_components(prints, distance):
    """rows of (id, fingerprint): smallest id reachable."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = defaultdict(list)
    for k, (i, _) in zip(label, prints):
        out[k].append(i)
    return [min((x for x in out[k] if x is not None), default=None) for k in label]


def test_components_match_brute_force(spark, docs, docs_rows):
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in docs_rows]
    expected = dict(zip([i for i, _ in prints], plain_components(prints, 3)))
    rows = simhash.fingerprint_components(clashing(docs)).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: format(f, "016x") for i, f in prints}
    assert {r.doc_id: r.component_id for r in rows} == expected and len(set(expected.values())) < len(rows)


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_planned_probes_lose_no_link(spark, distance):
    """Fingerprints in chains and balls: every pair within the distance ends in one component, no other does."""
    r = random.Random(distance)
    prints = []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            for _ in range(r.randrange(0, distance + 3)):
                x ^= 1 << r.randrange(64)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s, s) for s in signed], "node long, fp long").repartition(3)
    n, both = simhash.bit_counts(nodes)
    assert n == len(prints) and both[3][3] == sum(p >> 3 & 1 for p in prints)
    for most in (1, 2, 4, 8):
        plan = simhash.plan_partitions(n, both, distance, most)
        masks = simhash.probe_masks(plan)
        for i, a in enumerate(prints):
            for b in prints[:i]:
                if (a ^ b).bit_count() <= distance:
                    assert any((a ^ b) & m == 0 for m in masks)
    from chunkloom.llm.components import connected_components

    settings = simhash.Settings(distance=distance)
    roots = {x.node: x.root for x in connected_components(simhash.bucket_links(nodes, masks, settings)).collect()}
    expected = plain_components(list(zip(signed, prints)), distance)
    assert [roots.get(s, s) for s in signed] == expected


def test_large_buckets_are_searched_whole():
    r = np.random.default_rng(1)
    prints = np.unique(r.integers(0, 1 << 20, 9000).astype(np.uint64))
    linker = simhash.Linker(simhash.Settings())
    linker.best, linker.partner = np.full(len(prints), 1 << 30), np.zeros(len(prints), np.int64)
    found = linker.large(prints, None, np.arange(len(prints)), list(range(64)))
    from chunkloom.llm.components import local_forest

    label = local_forest(found[:, 0], found[:, 1], len(prints))
    some = r.integers(0, len(prints), 300)
    for i in some:
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)
        assert (label[near] == label[i]).all()


def test_simhash_of_awkward_rows(spark, awkward, empty):
    rows = simhash.fingerprint_components(awkward).collect()
    assert len(rows) == awkward.count() and simhash.fingerprint_components(empty).count() == 0
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    prints = [(d.doc_id, plain_fingerprint(d.text)) for d in awkward.where("octet_length(text) < 9000 OR text IS NULL").collect()]
    expected = sorted(map(str, zip(prints, plain_components(prints, 3))))
    small = simhash.near_duplicates(awkward.where("octet_length(text) < 9000 OR text IS NULL")).collect()
    assert sorted(str(((r.doc_id, r.fp & simhash.MASK), r.component_id)) for r in small) == expected
