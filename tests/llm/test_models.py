import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkloom.llm import ann, common, quality, queries, simhash, toxicity
from chunkloom.llm.classifier_data import labelled_sample
from tests.llm.conftest import DOCS, sentence

BIG = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


# --- training rows ---


def test_no_held_out_row_is_learnt_from(spark, docs, labels_schema):
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 7, 7)], labels_schema)
    got = labelled_sample(docs, labels, "quality").collect()
    assert {r.doc_id for r in got} == {i for i in range(60) if not held(i)} and all(r.y == r.doc_id % 2 for r in got)
    assert labelled_sample(docs, labels, "quality", 5).count() == 10
    assert sorted(r.doc_id for r in labelled_sample(docs, labels, "quality", 5).collect()) == sorted(r.doc_id for r in labelled_sample(docs.repartition(7), labels, "quality", 5).collect())


def test_held_out_labels_do_not_change_scores(spark, docs, labels_schema):
    rows = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(60)]
    flipped = [(i, 1 - q if held(i) else q, 1 - t if held(i) else t) for i, q, t in rows]
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = ({r.doc_id: (r.score, r.held_out) for r in score(docs, spark.createDataFrame(x, labels_schema)).collect()} for x in (rows, flipped))
        assert a == b and all(h == held(i) for i, (_, h) in a.items())


# --- quality ---


def test_linear_time_form_equals_the_sum_over_pairs():
    r = np.random.default_rng(1)
    s = quality.Settings(word_buckets=50, rank=3)
    m = quality.Machine(s, 0.3, r.normal(size=s.width), r.normal(size=(s.width, 3)))
    ids, values = r.choice(s.width, 12, replace=False), r.normal(size=12)
    pairs = sum(m.factors[ids[i]] @ m.factors[ids[j]] * values[i] * values[j] for i in range(12) for j in range(i))
    assert m.raw(ids, values, np.array([0]))[0][0] == pytest.approx(0.3 + m.linear[ids] @ values + pairs)


def test_machine_learns_an_interaction():
    """Two words that mean something only together: no linear score tells these classes apart."""
    s = quality.Settings(word_buckets=16, epochs=200, rate=0.2)
    rows = [(np.array([a, 2 + b], np.int32), np.ones(2, np.float32), int(a == b)) for a in (0, 1) for b in (0, 1)] * 40
    m = quality.fit(rows, s)
    assert all((m.scores(i, v, np.array([0]))[0] > 0.5) == y for i, v, y in rows[:4])
    assert (quality.fit(rows, s).factors == m.factors).all()


@pytest.mark.parametrize("query,label,least", [(queries.op3_quality, "quality", 0.95), (queries.op9_toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, query, label, least):
    """Area under the curve on rows that were not learnt from."""
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in query(spark, BIG).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > least


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_on_awkward_rows(spark, awkward, empty, scores, labels_schema):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)], labels_schema)
    none = spark.createDataFrame([], labels_schema)
    for known in (labels, none):
        rows = scores(awkward.withColumns({"score": F.lit("x"), "predicted": F.lit("x"), "held_out": F.lit(1), "y": F.lit(1)}), known).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in rows)
        assert len({r.score for r in rows if r.doc_id == 7}) == 1
        assert scores(empty, known).count() == 0
    if scores is quality.quality_scores:
        assert {r.score for r in rows} == {0.5}


# --- toxicity ---


def marks(text):
    grammar = toxicity.Grammar(toxicity.Lexicon())
    return [(*toxicity.CLASSES[k], w) for k, w in grammar.clauses(text)]


def test_transducers_mark_what_governs_a_hit():
    assert marks("You are an idiot.") == [("insult", "aimed", "", 2.5)]
    assert marks("the idiot") == [("insult", "bare", "", 2.5)]
    assert marks("You are not an idiot") == [("insult", "aimed", "negated", 2.5)]
    assert marks("She is not here. Idiot") == [("insult", "bare", "", 2.5)]
    assert marks('He said "idiot" and left')[0][2] == "reported"
    assert marks("they will murder") == [("threat", "aimed", "", 1.5)]
    assert marks("nothing to see") == [] and marks("") == []
    assert len(marks("idiot. idiot! fine; moron")) == 3


def test_patterns_of_a_clause():
    assert marks("Idiots and scum like you all") == [("insult", "answered", "", 2.5)]
    assert marks("What an utter clown") == [("insult", "compared", "", 2.5)]
    assert marks("Shut up, loser, now") == [("insult", "commanded", "", 2.5)]
    assert marks("I will kill you") == [("threat", "answered", "", 1.5)]
    assert marks("kill the process and burn the disc") == []  # a threat without a target
    assert marks("kill the old and slow process of yours") == []  # too far
    assert marks("never kill them") == [("threat", "answered", "negated", 1.5)]
    assert marks("I will kill you, idiot") == [("insult", "aimed", "", 2.5)]
    assert marks("let us go, moron") == [("insult", "bare", "", 2.5)]  # a command opens its clause


def test_scores_follow_patterns():
    model = toxicity.ToxicityModel(toxicity.Lexicon(), toxicity.PRIOR)
    grammar = toxicity.Grammar(model.lexicon)
    score = lambda text: float(model.scores(grammar.features(text)[None])[0])
    assert score("you are an idiot. you are scum") > score("an idiot. some scum") > score("you are no idiot. he wrote of scum") > score("kill the process") == score("")
    assert score("i will kill you. i will hurt you") > score("they kill time. they burn wood")


def test_composition_equals_feeding_one_into_the_next():
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.patterns()]
    whole = toxicity.compose(*parts)
    r = random.Random(3)
    symbols = [toxicity.OTHER, toxicity.END, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.QUOTE, toxicity.COMPARISON, toxicity.COMMAND, ("insult",), ("threat",)]
    state, states = whole.start, [p.start for p in parts]
    for _ in range(2000):
        s = out = r.choice(symbols)
        state, marked = whole.step(state, s)
        for i, p in enumerate(parts):
            states[i], out = p.step(states[i], out)
        assert marked == out and state == tuple(states)


def test_lexicon_grows_by_words_and_stems(spark, labels_schema):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence(r, 30).split()
        if toxic:
            words[r.randrange(30)] = "zorkin" + r.choice(["eth", "am", "ol", "ust", "ix", "ba"])
        rows.append((i, " ".join(words), "xx", "a", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels, labels_schema))
    assert any("zorkin".startswith(s) or s.startswith("zorkin") for s in model.lexicon.stems)
    got = toxicity.score_toxicity(docs, model, ["doc_id"]).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.97
    assert toxicity.score_toxicity(spark.createDataFrame([(1, "a zorkinuma thing")], "doc_id long, text string"), model, ["doc_id"]).first().predicted == 1


def test_association_sign():
    assert toxicity.association(10, 0, 20, 200) > 20 > 0 > toxicity.association(0, 50, 20, 200)
    assert toxicity.association(1, 10, 20, 200) == pytest.approx(0, abs=1e-9)


def test_every_term_of_the_sample_is_tested(spark):
    """A toxic word that is rarer than over 20,000 neutral words and stems is learnt all the same, and no neutral one is."""
    r = random.Random(8)
    neutral = " ".join("".join(r.choices("abcdefghijklmnop", k=12)) for _ in range(5000))
    rows = [(i, neutral + (" zorkinuma" if i < 20 else ""), int(i < 40)) for i in range(120)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3), 40, 80)
    assert set(lexicon.words) - set(toxicity.Lexicon().words) == {"zorkinuma"} and lexicon.stems and all("zorkinuma".startswith(s) for s in lexicon.stems)


# --- nearest neighbours ---


def brute_nearest(ids, x, q, k):
    s = x @ x[q]
    s[ids == ids[q]] = -math.inf
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), s[i]) for i in order if s[i] > -math.inf]


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(1), "salt": F.lit(1)})
    got = {}
    for row in ann.nearest(frame, F.col("vec_id") % 20 == 0, settings=ann.Settings(words=64, codebooks=8, min_rerank=60, rerank_share=0.02)).collect():
        got.setdefault(row.query_id, []).append(row)
    wide, hits = x.astype(np.float64), 0
    for q in range(0, 3000, 20):
        rows = sorted(got[q], key=lambda t: t["rank"])
        assert [t["rank"] for t in rows] == list(range(1, 21)) and all(a.score >= b.score for a, b in zip(rows, rows[1:])) and q not in {t.vec_id for t in rows}
        assert all(abs(t.score - wide[t.vec_id] @ wide[q]) < 1e-12 for t in rows)
        hits += len({t.vec_id for t in rows} & {i for i, _ in brute_nearest(np.arange(3000), wide, q, 20)})
    assert hits / (20 * 150) > 0.9 and len(got) == 150


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [-1.0, 0.0]), (None, [9.0, 9.0]), (5, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(t.query_id, t["rank"], t.vec_id, t.score) for t in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 0.5), (0, 2, 6, 0.5), (0, 3, 20, 0.0), (0, 4, 7, -1.0), (20, 1, 5, 1.0), (20, 2, 6, 1.0), (20, 3, 0, 0.0), (20, 4, 7, 0.0)]
    assert ann.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame.where("vec_id = 7"), F.col("vec_id") % 20 == 0).count() == 0
    euclid = ann.nearest(frame, F.col("vec_id") == 0, k=1, settings=ann.Settings(metric="euclidean")).first()
    assert (euclid.vec_id, euclid.score) == (5, pytest.approx(-math.sqrt(0.5)))


def test_repeated_rows_and_ties_of_vectors(spark):
    """Repeated queries and candidates give distinct ids; of 600 equal vectors, more than a shortlist holds, the smallest ids are found."""
    r = np.random.default_rng(7)
    x = r.normal(size=(2000, 8)).astype(np.float32)
    x[1001:1601] = x[1001] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[20], rows[20], rows[1005], rows[7]] * 2 + [(40, [9.0] * 8), (41, [9.0] * 8)]
    r.shuffle(rows)
    got = {}
    for t in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(t.query_id, {})[t["rank"]] = t.vec_id
    for i in (40, 41):
        x[i] = min(x[i].tolist(), [9.0] * 8)
    wide = x.astype(np.float64)
    assert len(got) == 100 and all(sorted(v) == list(range(1, 21)) and len(set(v.values())) == 20 for v in got.values())
    hits = ties = 0
    for q, found in got.items():
        exact = [i for i, _ in brute_nearest(np.arange(2000), wide, q, 20)]
        hits += len(set(exact) & set(found.values()))
        if set(exact) <= set(range(1001, 1601)):
            ties += 1
            assert [found[k] for k in range(1, 21)] == exact
    assert ties >= 20 and hits >= 0.9 * 2000


@pytest.mark.parametrize("size", [1.0, 1e60, 1e-60])
def test_doubles_are_scored_as_doubles(spark, size):
    """Registered settings; doubles that no float holds, and sizes beyond the range of floats."""
    x = np.random.default_rng(11).normal(size=(1500, 16)) * size
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert len(rows) == 75 * 20 and all(abs(t.score - x[t.vec_id] @ x[t.query_id]) <= 1e-13 * np.abs(x[t.vec_id] * x[t.query_id]).sum() for t in rows)
    hits = sum(len({i for i, _ in brute_nearest(np.arange(1500), x, q, 20)} & {t.vec_id for t in rows if t.query_id == q}) for q in range(0, 1500, 20))
    assert hits >= 0.9 * len(rows)


def test_joint_code_words_are_no_worse():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 16)).astype(np.float32)
    q = ann.train(x, ann.Settings(codebooks=4, words=32))
    error = ((x - q.decode(q.encode(x))) ** 2).sum(1).mean()
    greedy = ann.Quantiser(q.books, 1)
    assert error <= ((x - greedy.decode(greedy.encode(x))) ** 2).sum(1).mean() and error < 0.5 * (x**2).sum(1).mean()


# --- pipeline ---


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_names_and_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_low_quality", "drop_near_copies", "drop_repeats", "pack"]


def largest_batch(spark):
    """Bytes, of 400 rows of 20,000 in one partition that are passed to Python."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"]) for b in batches)
    return max(r.n for r in spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 20_000)).mapInArrow(sizes, "n long").collect())


def test_stages_pass_few_bytes_at_once(spark, docs, sf_dir):
    cached = docs.select(*corpus_pipeline.COLUMNS).cache()
    try:
        for _, stage in corpus_pipeline.STAGES:
            own = stage(spark, cached, sf_dir).sparkSession
            assert largest_batch(own) <= common.BYTES_AT_ONCE + 100_000 < 8_000_000 <= largest_batch(spark)
            assert int(own.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.ROWS_AT_ONCE
            assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
            assert cached.is_cached and cached.storageLevel.useMemory
    finally:
        cached.unpersist()


def test_smaller_bounds_of_the_caller_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for value, least, most in (("100k", 0, 160_000), ("2m", 900_000, common.BYTES_AT_ONCE + 100_000)):
            spark.conf.set(key, value)
            assert least < largest_batch(common.in_few_bytes(spark.range(3)).sparkSession) <= most
    finally:
        spark.conf.set(key, before)


def test_stages_against_plain_python(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in queries.op9_toxicity(spark, sf_dir).collect() if r.predicted}
    low = {r.doc_id for r in queries.op3_quality(spark, sf_dir).collect() if not r.predicted}
    seen = {}
    docs = source
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == source.columns
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    everything = {r.doc_id for r in source.collect()}
    assert ids["toxicity"] == everything - toxic and ids["quality"] == ids["toxicity"] - low
    text = {r.doc_id: r.text for r in source.collect()}
    sets = {i: shingles(text[i]) for i in ids["quality"]}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert pairs and sum(a in ids["simhash"] and b in ids["simhash"] for a, b in pairs) <= 0.02 * len(pairs)
    for gone in ids["quality"] - ids["simhash"]:
        assert any(len(sets[gone] & sets[k]) >= 0.8 * len(sets[gone] | sets[k]) for k in ids["quality"] if k != gone)
    before, known = sorted(seen["simhash"], key=lambda r: r.doc_id), set()
    after = {r.doc_id: r for r in seen["suffix_array"]}
    for r in before:
        raw = r.text.encode()
        mask = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in known:
                mask[s : s + 100] = b"\1" * 100
            known.add(raw[s : s + 100])
        kept = bytes(x for x, m in zip(raw, mask) if not m)
        if r.doc_id in after:
            got = after[r.doc_id].text
            assert got == r.text if not any(mask) else len(kept) <= len(got.encode()) <= len(kept) + 8 * mask.count(b"\1\0")
            assert not any(mask) or after[r.doc_id].n_chars == len(got)
        else:
            assert not kept
    assert ids["packing"] == ids["suffix_array"]
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in seen["packing"])


def test_stages_on_awkward_and_empty_tables(spark, sf_dir, awkward, empty, tmp_path):
    for k, frame in enumerate((awkward, empty)):
        docs = frame.withColumns({"score": F.lit(1), "predicted": F.lit(1), "kept": F.lit("x"), "spans": F.lit("x"), "node": F.lit(1)})
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() > 0) == (k == 0)


def test_near_copies_of_one_word(spark):
    r = random.Random(12)
    base = sentence(r, 300).split()
    rows = [(i, " ".join(base[:k] + ["other"] + base[k + 1 :]), "", "", 1) for i, k in enumerate(range(5, 290, 9))]
    rows += [(100 + i, sentence(r, 300), "", "", 1) for i in range(40)]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), simhash.FIVE_WORDS).collect()}
    assert sum(got[i] == 0 for i in range(32)) >= 31 and all(got[100 + i] == 100 + i for i in range(40))


def exact_components(sets, least=0.8):
    """The smallest id that each id reaches over pairs of sets that are similar enough; compared one by one."""
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


@pytest.mark.parametrize("cells", [0, 1 << 25])
def test_similar_sets_against_all_pairs(monkeypatch, cells):
    """By search and by bits: the forest holds together just what pairs at 0.8 or more do."""
    monkeypatch.setattr(simhash, "TABLE_CELLS", cells)
    r = random.Random(23)
    texts = []
    for _ in range(6):
        line = sentence(r, r.choice((20, 80, 300))).split()
        for _ in range(15):
            at = r.randrange(len(line))
            texts.append(" ".join([*line[:at], *(f"n{r.randrange(10**6)}" for _ in range(r.randrange(0, max(2, len(line) // 15)))), *line[at + 1 :]]))
    texts = list(dict.fromkeys(texts))
    sets = simhash.shingle_sets([t.encode() for t in texts], 5)
    a, b = simhash.similar_sets(np.array([simhash.set_fingerprint(x) for x in sets]), sets, simhash.FIVE_WORDS)
    got = simhash.local_forest(a, b, len(texts))
    expected = exact_components({i: shingles(t) for i, t in enumerate(texts)})
    assert {i: int(x) for i, x in enumerate(got)} == expected and len(set(expected.values())) > 6 and len(a) == len(texts) - len(set(expected.values()))


@pytest.mark.parametrize("block", [8 << 20, 30_000])
def test_candidates_that_a_forest_leaves_out_are_compared(spark, monkeypatch, block):
    """Families of versions that drift from one another: many candidate pairs are under 0.8, so a forest of candidates does not hold the links."""
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    r = random.Random(31)
    texts = []
    for versions in (12, 30, 12, 30, 12, 30):
        line = sentence(r, 400).split()
        for _ in range(versions):
            texts.append(" ".join(line))
            for _ in range(r.choice((3, 5, 7, 9))):
                k = r.randrange(len(line))
                line = [*line[:k], f"new{r.randrange(10**6)}", *line[k + 1 :]]
    r.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "", "", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs, simhash.FIVE_WORDS).collect()}
    expected = exact_components({i: shingles(t) for i, t in enumerate(texts)})
    assert got == expected and 6 <= len(set(expected.values())) < len(texts)


def test_replaced_and_appended_paragraphs_are_candidates(spark):
    """One contiguous change that leaves 0.8 to 0.9 of the five-word sets in common; every such pair is linked, none below 0.8 is."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    zipf = [1 / (i + 1) for i in range(5000)]
    texts = []
    for k in range(60):
        n = r.choice((60, 150, 400, 1000))
        line = r.choices(vocabulary, zipf, k=n)
        size = max(1, int(n * r.uniform(0.04, 0.22)))
        at = r.randrange(n - size)
        block = r.choices(vocabulary, zipf, k=size)
        texts += [" ".join(line), " ".join((line[:at] + block + line[at + size :], line + block, line[:at] + line[at + size :])[k % 3])]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    likeness = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)}
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame([(i, t, "", "", 1) for i, t in enumerate(texts)], DOCS), simhash.FIVE_WORDS).collect()}
    assert sum(0.8 <= j < 0.9 for j in likeness.values()) > 15 and min(likeness.values()) < 0.8
    assert got == {i: i - 1 if i % 2 and likeness[i - 1] >= 0.8 else i for i in got}


def test_unlike_rows_of_one_id_are_kept(spark, sf_dir):
    """Rows that share an id, or have none, are told apart by their texts; only copies go."""
    r = random.Random(77)
    a, b, c, d = (sentence(r, 60) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c + " end"), (None, c + " end"), (None, d), (None, d), (None, sentence(r, 50)), (4, None), (5, ""), (6, sentence(r, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = sorted(((x.doc_id, x.text or "") for x in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()), key=str)
    expected = [(1, a), (1, b), (3, c + " end"), (None, d), rows[8], (4, ""), rows[11]]
    assert got == sorted(expected, key=str)


def test_sets_of_shingles_are_those_of_the_words():
    r = random.Random(3)
    texts = ["", " \t\n", "One", "one two", "A b C d", "a b c d e", "e d c b a", "a  b\x0bc\fd\r\ne", sentence(r, 700), "x" * 70_000 + " y", "a b c d e a b c d e a", "ÉA b", "Éa B"]
    got = [h for portion in simhash.text_portions([None, *texts]) for h in simhash.shingle_sets(portion, 5)]
    assert len(got) == len(texts) + 1 and [len(h) for h in got] == [0, *(len(shingles(t)) for t in texts)]
    assert all((set(x.tolist()) == set(y.tolist())) == (shingles(s) == shingles(t)) for x, s in zip(got[1:], texts) for y, t in zip(got[1:], texts))
    many = np.random.default_rng(1).integers(0, 1 << 63, 40_000, np.uint64)
    bits = np.unpackbits(many.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    assert simhash.majority(many) == sum(1 << i for i in range(64) if 2 * bits[i] > len(many))


def test_features_reach_the_driver_small_and_unchanged():
    """A text of 20,000 unlike words: what is sent is under half of eight bytes a word, and nothing of it is lost."""
    text = " ".join(f"w{i * 7919}" for i in range(20_000)) + " again" * 50
    ids, values = quality.Features(quality.Settings()).of(text)
    sent = quality.sent_features(ids, values)
    back = quality.received_features(sent)
    assert len(sent) < 4 * len(ids)
    assert (back[0] == ids).all() and (back[1] == values).all() and back[0].dtype == ids.dtype and back[1].dtype == values.dtype
    empty = quality.Features(quality.Settings()).of("")
    assert all((x == y).all() for x, y in zip(quality.received_features(quality.sent_features(*empty)), empty))
