"""Bounded samples of labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import held_out

#: At most so many labelled rows of each class are learnt from; they are the first by a hash of doc_id.
MAX_ROWS_PER_CLASS = 8192


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows_per_class: int = MAX_ROWS_PER_CLASS) -> DataFrame:
    """doc_id, text, y of at most max_rows_per_class training rows per class.

    Only ids whose crc32 remainder is not 1 are taken. The sampled labels are bounded (2 x max_rows_per_class rows of 12
    bytes), so they are broadcast to the one scan of documents. Null ids, null labels and labels other than 0 and 1 are left out;
    an id with labels of both classes counts in both; of rows that share an id the least text counts, so there are no more rows than labels.
    """
    ok = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id")).distinct()
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.col("doc_id")]
    picked = ok.where("y = 0").orderBy(*order).limit(max_rows_per_class).unionByName(ok.where("y = 1").orderBy(*order).limit(max_rows_per_class))
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
