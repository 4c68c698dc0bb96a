"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark, so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that the Parquet reader and a batch to Python hold at once where whole texts pass. Spark's own 4,096 and 10,000 count rows, not bytes,
#: so that most of a partition's texts lie in arrays of one piece.
ROWS_AT_ONCE = 256
#: Bytes that a batch to Python holds (but for a longer row) where narrow rows pass by the million beside whole texts.
BYTES_AT_ONCE = 1 << 20
_READ_ROWS, _SENT_ROWS, _SENT_BYTES = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _amount(value: str) -> int:
    """A number of rows, or of bytes with or without a unit."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", value.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def _own_session(spark: SparkSession, bounds: dict[str, int]) -> SparkSession:
    """A session with the settings of this one, but for these bounds. The caller's own keeps its settings."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            own.conf.set(key, value)
    for key, most in bounds.items():
        known = _amount(spark.conf.get(key))
        own.conf.set(key, min(known, most) if known > 0 else most)  # none or fewer: no bound
    return own


def in_small_batches(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, but at most ROWS_AT_ONCE rows in a batch."""
    return _own_session(spark, {_READ_ROWS: ROWS_AT_ONCE, _SENT_ROWS: ROWS_AT_ONCE})


def few_bytes_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, but at most ROWS_AT_ONCE rows read and BYTES_AT_ONCE bytes sent to Python at once."""
    return _own_session(spark, {_READ_ROWS: ROWS_AT_ONCE, _SENT_BYTES: BYTES_AT_ONCE})


def in_few_bytes(docs: DataFrame) -> DataFrame:
    """docs in a few_bytes_session. Files that docs themselves read are read as their former session reads them."""
    own = few_bytes_session(docs.sparkSession)
    name = f"docs_{uuid.uuid4().hex}"
    docs.where(F.lit(True)).createOrReplaceGlobalTempView(name)  # of docs' own plan, dropping the view would drop what is cached
    try:
        return own.table(f"{own.conf.get('spark.sql.globalTempDatabase')}.{name}")
    finally:
        own.catalog.dropGlobalTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what outlives a stage: the one that the cluster names in spark.checkpoint.dir.

    Only where none is set, and Spark runs on this machine alone, one is made here; a cluster's executors could not see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there, so that a lost executor costs one reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut, but as a table of that folder, whose size is then known from its files.

    A checkpoint keeps the estimate of its plan, which is a product over each join: over some rounds of joins it grows past all use.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str) -> Column:
    """True for rows that no classifier may learn from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse mod 2 ** 64, up to n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]
