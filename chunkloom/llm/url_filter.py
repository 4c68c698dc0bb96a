"""URL filtering: host/path rules, then a weighted vocabulary counted with an Aho-Corasick automaton.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and holds no term
(verdict ``allow``). Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One of these in a host or path is enough.
STRICT_TERMS = ("casino", "escorts", "hentai", "jackpot", "milf", "porn", "porno", "pornhub", "sexcam", "viagra", "warez", "xxx")

# Weights of terms that count only together with others.
SOFT_TERMS = {
    "adult": 2, "ads": 2, "adserver": 2, "bet": 2, "bets": 2, "betting": 2, "bonus": 1, "cams": 2, "cheap": 1, "click": 1,
    "crack": 1, "deal": 1, "deals": 1, "diet": 1, "farm": 1, "free": 1, "gamble": 2, "gambling": 2, "keygen": 2, "loan": 2,
    "loans": 2, "lottery": 2, "meds": 2, "nude": 2, "pharmacy": 2, "pill": 2, "pills": 2, "poker": 2, "promo": 1, "replica": 2,
    "sex": 2, "sexy": 2, "slots": 2, "spam": 2, "torrent": 2, "track": 1, "tracker": 1, "win": 1, "winner": 1, "x": 1,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and every path that starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules that come before the vocabulary.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Vocabulary:
    strict: Sequence[str] = STRICT_TERMS
    soft: Mapping[str, int] = field(default_factory=lambda: dict(SOFT_TERMS))
    min_soft_terms: int = 2
    min_soft_weight: int = 3

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term in self.strict:
            found.add_word(term, (term, 0))
        for term, weight in self.soft.items():
            found.add_word(term, (term, weight))
        found.make_automaton()
        return found


def _word_char(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def count_terms(automaton: ahocorasick.Automaton, text: str) -> tuple[int, int, int]:
    """Distinct strict terms, distinct soft terms and the weight of the latter; a term must stand between boundaries."""
    strict, soft = set(), {}
    for end, (term, weight) in automaton.iter(text):
        start = end - len(term) + 1
        if (start and _word_char(text[start - 1])) or (end + 1 < len(text) and _word_char(text[end + 1])):
            continue
        if weight:
            soft[term] = weight
        else:
            strict.add(term)
    return len(strict), len(soft), sum(soft.values())


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url)))
    return df.withColumns(
        {
            "host": F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit("")),
            "path": F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1), F.lit("")),
        }
    )


def longest_rule(rules: Iterable[Rule], host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits, else null: one CASE, so the rules cost no join."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """key, host, path, rule, verdict, strict_terms, soft_terms, soft_weight for every row of pages.

    The rules are column expressions; one Arrow pass, without a shuffle, counts the vocabulary's terms in host and path.
    """
    words = vocabulary or Vocabulary()
    parts = with_host_and_path(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))).select(
        "page_id", "host", "path",
        longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.name).alias("rule"),
        longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("ruled"),
        F.translate(F.concat("host", "path"), _UPPER, _LOWER).alias("_text"),
    )
    key_type = parts.schema["page_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = words.automaton()
        for batch in batches:
            counts = [count_terms(automaton, text) for text in batch.column(5).to_pylist()]
            columns = [pa.array([c[i] for c in counts], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *columns], ["page_id", "host", "path", "rule", "ruled", "strict_terms", "soft_terms", "soft_weight"])

    counted = parts.mapInArrow(count, f"page_id {key_type}, host string, path string, rule string, ruled string, strict_terms int, soft_terms int, soft_weight int")
    rejected = (F.col("strict_terms") > 0) | ((F.col("soft_terms") >= words.min_soft_terms) & (F.col("soft_weight") >= words.min_soft_weight))
    verdict = F.coalesce("ruled", F.when(rejected, F.lit("block")).otherwise(F.lit("allow")))
    return counted.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "strict_terms", "soft_terms", "soft_weight")
