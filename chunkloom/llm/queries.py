"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import ann, bpe, fingerprints, packing, quality, sharding, simhash, suffix_dedup, toxicity, url_filter
from chunkloom.llm.common import in_small_batches, read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read_table(in_small_batches(spark), sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = in_small_batches(spark)
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(read_table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    return bpe.encoded_digests(read_table(spark, sf_dir, "documents"), vocabulary_path or public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_quality, op4_sharding, op5_fingerprints, op6_neighbours, op7_bpe, op8_simhash, op9_toxicity, op10_packing)}


def _url_filter_sql() -> str:
    words = url_filter.Vocabulary()
    text = "translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda term: f"regexp_matches(t, '(^|[^a-z0-9]){term}($|[^a-z0-9])')::INT"
    strict = " + ".join(hit(t) for t in words.strict)
    soft = " + ".join(hit(t) for t in words.soft)
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in words.soft.items())
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
t AS (SELECT *, {text} AS t FROM h),
c AS (SELECT page_id, host, path,
        CASE {' '.join(f"{fits(r)} '{r.name}'" for r in rules)} END AS rule,
        CASE {' '.join(f"{fits(r)} '{r.verdict}'" for r in rules)} END AS ruled,
        CAST({strict} AS INTEGER) AS strict_terms, CAST({soft} AS INTEGER) AS soft_terms, CAST({weight} AS INTEGER) AS soft_weight FROM t)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN strict_terms > 0 OR (soft_terms >= {words.min_soft_terms} AND soft_weight >= {words.min_soft_weight}) THEN 'block' ELSE 'allow' END) AS verdict,
       strict_terms, soft_terms, soft_weight
FROM c"""


#: Every string of 100 bytes as a row; those not first in order are islands of removed bytes.
_SUFFIX_DEDUP_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, CAST(2 * s + 1 AS BIGINT), 200)) AS w FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS s FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS f FROM r),
i AS (SELECT doc_id, s, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM g),
spans AS (SELECT doc_id, n, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, n),
sums AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last FROM spans GROUP BY doc_id),
parts AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM spans UNION ALL SELECT doc_id, 1000000000000, last, 1000000000000 FROM sums),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(least(2 * (q - p), len(h)) AS BIGINT)), '' ORDER BY a) AS k FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _SUFFIX_DEDUP_SQL, "op2_url_filter": _url_filter_sql()}
