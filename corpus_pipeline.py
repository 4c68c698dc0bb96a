"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet and rereads it for the next.
All but the last return the columns of documents. A stage works in a session of its own, with the settings of docs' session but for smaller batches.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import packing, quality, simhash, suffix_dedup, toxicity
from chunkloom.llm.common import few_bytes_session, in_few_bytes, read_table, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on sf_dir's labelled training rows, does not reject (score under 0.7)."""
    docs = in_few_bytes(docs.select(*COLUMNS))
    spark = docs.sparkSession
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on sf_dir's labelled training rows, does not reject (score of 0.5 or more)."""
    docs = in_few_bytes(docs.select(*COLUMNS))
    spark = docs.sparkSession
    machine = quality.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, machine, COLUMNS).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    The row of the smallest id stays (rows without an id come last); of rows that share it, that of the least digest of its text. Equal rows
    are one document. Unlike texts are never taken for each other because they share an id or have none. An empty table stays empty.
    """
    docs = in_few_bytes(docs.select(*COLUMNS))
    no_id = F.lit((1 << 63) - 1)
    groups = simhash.near_duplicates(docs, simhash.FIVE_WORDS)
    first = F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("_id"), F.col("digest").alias("_digest"))).alias("row")
    firsts = groups.groupBy("component").agg(first).select("row._id", "row._digest")
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), no_id).alias("_id"), F.xxhash64("text").alias("_digest"))
    return keyed.join(firsts, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes or more that start earlier too; documents of which nothing is left go.

    Cuts shrink to whole characters, and n_chars is counted anew. Texts that were empty before stay as they are.
    """
    kept = suffix_dedup.without_repeats(in_few_bytes(docs.select(*COLUMNS)), whole_characters=True)
    changed = F.size("spans") > 0
    text = F.when(changed, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    return kept.where(~(changed & (F.octet_length("kept") == 0))).select(
        "doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.packed(in_few_bytes(docs.select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_copies),
    ("suffix_array", drop_repeats),
    ("packing", pack),
]

#: Models, hashes and packing are not expressible in SQL; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What passes between stages is in the folder of checkpoints that all executors share."""
    spark = few_bytes_session(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
