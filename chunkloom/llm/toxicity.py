"""Toxicity: a weighted finite-state grammar over clauses.

A lexical transducer turns words into symbols (insult, threat, target, comparison, command, negation, report, clause end, other). Three
more, composed with it, follow negation, reported speech and patterns through a clause. The pattern transducer knows target and hit ("you
are an idiot"), hit and target ("idiots like you", "kill them"), comparison ("such a clown"), command ("shut up, moron") and a bare
hit; each pattern has a weight, and so has what governs it. A clause counts by its best pattern (weight of the word times weight of
the pattern), so a verb of threat without a target matches nothing, and a negated or quoted insult little. A document's score is a
logistic function of its matched clauses by pattern.

The lexicon starts from a short general list of insults, threats and function words in four languages, written without looking at any
table, and grows by words and stems that mark toxic training rows. Their weights (log odds, drawn to zero where rows are few) and those of
the patterns (drawn to PRIOR) are learnt from a bounded sample (classifier_data.MAX_ROWS_PER_CLASS rows of each class).

Cases: null and empty texts hold no clause and get the lowest score; very long texts are read whole, in one pass; repeated rows get
equal scores; null and repeated ids are passed on; an empty table gives no row; extra columns, whatever their names, are ignored; without
training rows the starting lexicon and weights are used.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.classifier_data import labelled_sample
from chunkloom.llm.common import cut, held_out

# Starting lexicon in four languages.
INSULTS = (
    "abruti arschloch asshole bastard bitch cabrón clown connard crétin cretino degenerate disgusting dumbass dummkopf dégoûtant "
    "estúpido filth garbage gilipollas idiot idiota idiote imbecile imbécil imbécile lächerlich loser maldito minable moron "
    "mistkerl nutzlos parasite pathetic pathétique payaso retard salaud scum scumbag stupid stupide subhuman trash trottel "
    "vermin versager worthless"
).split()
THREATS = "abknallen ahorcar beat burn destroy erschießen étrangler hang hurt kill matar murder rape shoot stab strangle töten umbringen".split()
TARGETS = (
    "you your yours yourself u he him his she her they them their these those people du dich dir dein deine ihr euch sie "
    "tu toi te vous votre vos il elle ils elles usted ustedes él ella ellos tú ti vosotros"
).split()
NEGATIONS = "not no never none nor isn't aren't don't nicht kein keine keinen nie niemals pas jamais aucun nunca jamás tampoco ningún".split()
REPORTS = (
    "said says say told wrote writes called calls claimed claims quoted quote reported according sagte sagt schrieb nannte laut "
    "dit disait écrit écrivait appelle selon dijo dice escribió llamó según"
).split()
COMPARISONS = "like such total complete utter absolute wie solch solche solcher comme tel telle quel quelle como menudo menuda tan qué".split()
COMMANDS = "shut go get leave stop halt geh verschwinde hau ferme dégage tais va vete cállate lárgate cierra".split()

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:|\n\"«»„“”]")
_CLAUSE_ENDS, _QUOTES = set(".!?;:|\n"), set("\"«»„“”")
STEM_LENGTHS = (4, 5, 6, 7, 8)

Symbol = tuple[str, ...]
OTHER, END, TARGET, NEGATION, REPORT, QUOTE = ("other",), ("end",), ("target",), ("negation",), ("report",), ("quote",)
COMPARISON, COMMAND = ("comparison",), ("command",)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, symbol) gives the next state and the symbol to pass on."""

    start: object
    step: Callable[[object, Symbol], tuple[object, Symbol]]


def _is_hit(s: Symbol) -> bool:
    return s[0] in ("insult", "threat")


def negation(scope: int = 4) -> Transducer:
    """Marks hits that stand at most scope words after a negation in the same clause."""

    def step(left: int, s: Symbol) -> tuple[int, Symbol]:
        if s == NEGATION:
            return scope, s
        if s == END:
            return 0, s
        return max(0, left - 1), (*s, "negated") if left and _is_hit(s) else s

    return Transducer(0, step)


def reported_speech() -> Transducer:
    """Marks hits after a verb of saying, or between quotation marks that follow one."""

    def step(state: tuple[bool, bool], s: Symbol) -> tuple[tuple[bool, bool], Symbol]:
        told, quoted = state
        if s == REPORT:
            return (True, quoted), s
        if s == QUOTE:
            return (told, told and not quoted), s
        if s == END and not quoted:
            return (False, False), s
        return state, (*s, "reported") if (told or quoted) and _is_hit(s) else s

    return Transducer((False, False), step)


def patterns(reach: int = 6, near: int = 3) -> Transducer:
    """Marks hits with the pattern that they complete, and targets that complete the pattern of a hit before them.

    A target reaches so many words ahead, a comparison, a command or a hit that waits for its target only `near` words. A command counts
    at the start of a clause alone.
    """

    def step(state: tuple[int, int, int, int, bool], s: Symbol) -> tuple[tuple[int, int, int, int, bool], Symbol]:
        target, comparison, command, hit, opening = state
        if s == END:
            return (0, 0, 0, 0, True), s
        after = [max(0, n - 1) for n in (target, comparison, command, hit)]
        if s == TARGET:
            return (reach, *after[1:3], 0, False), (*s, "answers") if hit else s
        if s == COMPARISON:
            after[1] = near
        elif s == COMMAND and opening:
            after[2] = near
        elif _is_hit(s):
            after[3] = near
            return (*after, False), (*s, "aimed" if target else "commanded" if command else "compared" if comparison else "bare")
        return (*after, opening and s == QUOTE), s

    return Transducer((0, 0, 0, 0, True), step)


def compose(*parts: Transducer) -> Transducer:
    """One transducer that feeds each part's output to the next; transitions are worked out once and remembered."""
    known: dict[tuple[object, Symbol], tuple[object, Symbol]] = {}

    def step(states: tuple, s: Symbol) -> tuple[tuple, Symbol]:
        key = (states, s)
        if key not in known:
            out, after = s, []
            for part, state in zip(parts, states, strict=True):
                state, out = part.step(state, out)
                after.append(state)
            known[key] = tuple(after), out
        return known[key]

    return Transducer(tuple(p.start for p in parts), step)


#: Weights of the patterns before training, by kind of hit. A threat needs somebody whom it is meant for.
PATTERNS = {
    "insult": {"bare": 1.0, "compared": 1.1, "commanded": 1.15, "aimed": 1.25, "answered": 1.25},
    "threat": {"bare": 0.0, "compared": 0.2, "commanded": 0.6, "aimed": 0.8, "answered": 1.5},
}
#: What is left of a pattern's weight where it is negated or reported.
WEAK = {"": 1.0, "negated": 0.35, "reported": 0.5}
#: A matched pattern's class: kind of hit, pattern, what weakens it.
CLASSES = [(kind, pattern, weak) for kind, known in PATTERNS.items() for pattern in known for weak in WEAK]
_CLASS_AT = {c: i for i, c in enumerate(CLASSES)}
WIDTH = len(CLASSES) + 2
PRIOR = np.array([PATTERNS[kind][pattern] * WEAK[weak] for kind, pattern, weak in CLASSES] + [0.5, -3.5])


@dataclass
class Lexicon:
    """Weights of words, and of stems that any longer word may start with."""

    words: dict[str, tuple[str, float]] = field(default_factory=lambda: {w: ("insult", 2.5) for w in INSULTS} | {w: ("threat", 1.5) for w in THREATS})
    stems: dict[str, float] = field(default_factory=dict)


class Grammar:
    """The composed transducers over one lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.machine = compose(negation(), reported_speech(), patterns())
        self.fixed: dict[str, tuple[Symbol, float]] = {}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (COMPARISONS, COMPARISON), (COMMANDS, COMMAND), (_QUOTES, QUOTE), (_CLAUSE_ENDS, END)):
            self.fixed |= {w: (symbol, 0.0) for w in words}
        self.fixed |= {w: ((kind,), weight) for w, (kind, weight) in lexicon.words.items() if weight > 0}
        self.hits = {w for w, (symbol, _) in self.fixed.items() if _is_hit(symbol)}
        self.leads = {stem[: STEM_LENGTHS[0]] for stem in lexicon.stems}

    def _stem(self, word: str) -> tuple[Symbol, float] | None:
        """The longest stem that a longer word starts with."""
        for n in reversed(STEM_LENGTHS):
            if len(word) > n and (weight := self.lexicon.stems.get(word[:n])):
                return ("insult",), weight
        return None

    def clauses(self, text: str) -> list[tuple[int, float]]:
        """(class, weight of the word) of the best pattern of every matched clause. Texts without a word of the lexicon never reach the transducers."""
        tokens = _TOKEN.findall(text.lower())
        distinct, lead = set(tokens), STEM_LENGTHS[0]
        stems = {w: found for w in distinct if w[:lead] in self.leads and w not in self.fixed and (found := self._stem(w))}
        if not stems and self.hits.isdisjoint(distinct):
            return []
        known, plain = self.fixed | stems, (OTHER, 0.0)
        out, best, waiting, state, step = [], (0.0, 0, 0.0), None, self.machine.start, self.machine.step
        for token in tokens:
            symbol, weight = known.get(token, plain)
            state, marked = step(state, symbol)
            if weight:
                weak = "negated" if "negated" in marked else "reported" if "reported" in marked else ""
                waiting = marked[0], weak, weight
                k = _CLASS_AT[marked[0], marked[-1], weak]
                best = max(best, (weight * PRIOR[k], k, weight))
            elif marked[-1] == "answers" and waiting:
                k = _CLASS_AT[waiting[0], "answered", waiting[1]]
                best = max(best, (waiting[2] * PRIOR[k], k, waiting[2]))
            elif symbol == END:
                if best[0] > 0:
                    out.append(best[1:])
                best, waiting = (0.0, 0, 0.0), None
        return [*out, best[1:]] if best[0] > 0 else out

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(WIDTH)
        matched = self.clauses(text) if text else []
        for k, weight in matched:
            x[k] += weight
        np.minimum(x, 12, out=x)
        x[-2:] = math.log1p(len(matched)), 1
        return x


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def _terms(text: str | None) -> set[str]:
    """Words of a text, and their stems with a star."""
    words = {w for w in _TOKEN.findall((text or "").lower()) if w[0].isalpha()}
    return words | {f"{w[:n]}*" for n in STEM_LENGTHS for w in words if len(w) > n}


#: Terms that a task counts before it sends their numbers on.
HELD_TERMS = 500_000


def _term_counts(sample: DataFrame, y: int) -> DataFrame:
    """term, n: documents of class y that hold it; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_terms(text))
                if len(seen) > HELD_TERMS:
                    yield sent()
                    seen = Counter()
        yield sent()

    return sample.where(F.col("y") == y).select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _association_column(a: Column, b: Column, n1: int, n0: int) -> Column:
    """association() of columns a and b."""
    out = F.lit(0.0)
    for got, of in ((a, n1), (b, n0)):
        mean = (a + b) * of / (n1 + n0)
        for x, m in ((got, mean), (of - got, of - mean)):
            out += F.when((x > 0) & (m > 0), 2 * x * F.log(x / m)).otherwise(0.0)
    return F.when(a * n0 > b * n1, out).otherwise(-out)


def association(a: int, b: int, n1: int, n0: int) -> float:
    """Signed likelihood ratio (G squared) of a term that a of n1 toxic and b of n0 other documents hold."""
    out = 0.0
    for got, of in ((a, n1), (b, n0)):
        mean = (a + b) * of / (n1 + n0)
        for x, m in ((got, mean), (of - got, of - mean)):
            out += 2 * x * math.log(x / m) if x > 0 and m > 0 else 0
    return out if a * n0 > b * n1 else -out


def learn_lexicon(sample: DataFrame, n1: int, n0: int, least_g2: float = 20.0, least_ratio: float = 6.0, shrink: float = 1.0) -> Lexicon:
    """The starting lexicon, reweighed, plus all words and stems that mark toxic rows of the (bounded) sample.

    Every term that three toxic rows hold is tested, where the terms are counted; only those that pass and the starting words reach the
    driver. Weights are log odds, drawn to zero as if by shrink further rows that say nothing.
    """
    lexicon = Lexicon()
    if not n1 or not n0:
        return lexicon
    toxic, clean = (_term_counts(sample, y).withColumnRenamed("n", name) for y, name in ((1, "a"), (0, "b")))
    started = F.col("term").isin(list(lexicon.words))
    counts = cut(toxic.join(clean, "term", "full").fillna(0, ["a", "b"]).where((F.col("a") >= 3) | started))
    marks = counts.where((F.col("a") >= 3) & (F.col("a") / n1 >= least_ratio * F.col("b") / n0)).withColumn("g2", _association_column(F.col("a"), F.col("b"), n1, n0))
    best = marks.where(F.col("g2") >= least_g2).orderBy(F.desc("g2"), F.desc("term")).collect()
    known = {r.term: r for r in [*counts.where(started).collect(), *best]}
    a, b = {t: r.a for t, r in known.items()}, {t: r.b for t, r in known.items()}
    rows = lambda t: a.get(t, 0) + b.get(t, 0)
    odds = lambda t: (math.log((a.get(t, 0) + 0.5) / (n1 + 1)) - math.log((b.get(t, 0) + 0.5) / (n0 + 1))) * rows(t) / (rows(t) + shrink)
    for word, (kind, _) in list(lexicon.words.items()):
        if rows(word) >= 5:
            lexicon.words[word] = (kind, max(0.0, min(6.0, odds(word))))
    for term in (r.term for r in best):
        if term.endswith("*"):
            lexicon.stems[term[:-1]] = min(6.0, odds(term))
        elif term not in lexicon.words:
            lexicon.words[term] = ("insult", min(6.0, odds(term)))
    # of stems that say the same, the longest stays: it fits the fewest other words
    same = lambda s, longer: longer != s and longer.startswith(s) and a[f"{longer}*"] >= 0.95 * a[f"{s}*"]
    lexicon.stems = {s: w for s, w in lexicon.stems.items() if not any(same(s, x) for x in lexicon.stems)}
    return lexicon


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 2.0, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR."""
    w = PRIOR.copy()
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - y) + pull * (w - PRIOR)
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(WIDTH), gradient)
            w -= move / max(1.0, np.abs(move).max())
            if np.abs(move).max() < 1e-6:
                break
    return w


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of each class for each pair of least word hashes. Near copies share them; their rare words would pass for signs of a class."""
    least = F.slice(F.array_sort(F.transform(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")), lambda w: F.xxhash64(w))), 1, 2)
    first = F.min(F.struct("doc_id", "text")).alias("row")
    return sample.groupBy("y", least.alias("least")).agg(first).select("row.doc_id", "row.text", "y")


def train(documents: DataFrame, labels: DataFrame, max_rows_per_class: int | None = None) -> ToxicityModel:
    sample = cut(without_copies(labelled_sample(documents, labels, "toxic", *([max_rows_per_class] if max_rows_per_class else []))))
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    lexicon = learn_lexicon(sample, sizes.get(1, 0), sizes.get(0, 0))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array([grammar.features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["y", "doc_id", "x"])

    rows = sample.select("y", "doc_id", "text").mapInArrow(featurise, "y int, doc_id string, x binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r.doc_id.encode()), r.doc_id, r.y, bytes(r.x)))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), WIDTH)
    return ToxicityModel(lexicon, fit_weights(x, np.array([r.y for r in rows], float)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """The columns keep, then clauses (matched ones), score and predicted. One Arrow pass without a shuffle; the model is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col("text").alias("_text"), *keep)
    schema = chosen.select(*keep, F.lit(0).alias("clauses"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(shared.value.lexicon)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column(0).to_pylist()]).reshape(batch.num_rows, WIDTH)
            got = shared.value.scores(x)
            matched = np.rint(np.expm1(x[:, -2])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(matched), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], [*keep, "clauses", "score", "predicted"])

    return chosen.mapInArrow(score, schema)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses for every document."""
    scored = score_toxicity(documents, train(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "clauses")
