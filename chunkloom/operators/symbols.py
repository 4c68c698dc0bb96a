"""Histograms of symbols, their order, and prefix codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Keys whose bytes a task counts before it sends their numbers on.
HELD_KEYS = 4096


def byte_histogram(df: DataFrame, column: str) -> DataFrame:
    """value, frequency of the bytes of a text or binary column that occur.

    Each task counts whole Arrow buffers and sends at most 256 rows to the shuffle; exploding bytes into rows costs 20 times as much.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    total += np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["value", "n"])

    return df.select(column).mapInArrow(count, "value int, n long").groupBy("value").agg(F.sum("n").alias("frequency"))


def byte_histogram_by(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, value, frequency for all bytes 0..255 of a text or binary column, empty bins included, of each key that has any byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[object, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            n = len(totals)
            keys = pa.array([k for k in totals for _ in range(256)], kind)
            return pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(256, dtype=np.int32), n)), pa.array(np.concatenate(list(totals.values())))], [key, "value", "n"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if value.is_valid and len(value.as_buffer()):
                    if own not in totals and len(totals) == HELD_KEYS:
                        yield sent()
                        totals = {}
                    totals.setdefault(own, np.zeros(256, np.int64))[:] += np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
        if totals:
            yield sent()

    chosen = df.select(key, column)
    counts = chosen.mapInArrow(count, f"{key} {chosen.schema[0].dataType.simpleString()}, value int, n long")
    return counts.groupBy(key, "value").agg(F.sum("n").alias("frequency"))


def symbol_histogram(symbols: DataFrame, size: int, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """keys, value, frequency for all values 0..size-1, empty bins included (256 to 288 of them for each key)."""
    counts = symbols.where(F.col(value).between(0, size - 1)).groupBy(*keys, value).agg(F.count("*").alias("frequency"))
    bins = symbols.sparkSession.range(size).select(F.col("id").cast("int").alias(value))
    if keys:
        # every key gets its own bins: one generated array a key, not a join of all keys with all bins
        bins = symbols.select(*keys).distinct().withColumn(value, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return bins.join(counts, [*keys, value], "left").select(*keys, value, F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"))


def by_frequency(histogram: DataFrame) -> DataFrame:
    """Most frequent first, ties by value."""
    return histogram.orderBy(F.desc("frequency"), "value")


def by_value(histogram: DataFrame) -> DataFrame:
    return histogram.orderBy("value")


def non_empty(histogram: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many bins are not empty."""
    return histogram.groupBy(*keys).agg(F.count_if(F.col("frequency") > 0).alias("non_empty"))


def first_occurrence(symbols: DataFrame, keys: tuple[str, ...] = (), position: str = "pos", value: str = "value") -> DataFrame:
    return symbols.groupBy(*keys, value).agg(F.min(position).alias("first_pos"))


def code_length_histogram(lengths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """len, n of the code lengths in use (0 means no code)."""
    return lengths.where("len > 0").groupBy(*keys, "len").agg(F.count("*").alias("n"))


def longest_code(lengths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return lengths.groupBy(*keys).agg(F.max("len").alias("max_len"))


def canonical_codes(lengths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, sym, len, code: codes of one length are consecutive in symbol order, from the first code of that length.

    The recurrence first(L) = 2 (first(L-1) + n(L-1)) closes to the sum of n(l) 2^(L-l) over shorter l: with 15 as the longest length, a
    running sum of n(l) 2^(15-l), shifted back. Both windows are within a key's alphabet (at most 288 symbols).
    """
    scale = 15
    part = [F.col(k) for k in keys]
    used = lengths.where("len > 0")
    weight = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(scale) - F.col("len"))
    window = Window.partitionBy(*part).orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)
    # the scaled code of a symbol is the weight of all symbols before it in (length, symbol) order
    scaled = F.coalesce(F.sum(weight).over(window), F.lit(0).cast("long"))
    return used.withColumn("code", F.call_function("shiftright", scaled, F.lit(scale) - F.col("len"))).select(*keys, "sym", "len", "code")


def kraft_sum(codes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """1 for a full prefix code."""
    return codes.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"))


def adjacent_levels(frequencies: list[int]) -> list[int]:
    """Depths of the leaves of the tree that repeatedly joins neighbours at the light end of a descending list.

    The last two weights are joined, or the two before the last if their sum is smaller; the joined weight stays in its place. The tree keeps
    the order of the leaves and need not be minimal. One leaf has depth 1.
    """
    depth = [0] * len(frequencies)
    if len(frequencies) == 1:
        return [1]
    nodes = [(f, [i]) for i, f in enumerate(frequencies)]
    while len(nodes) > 1:
        at = len(nodes) - 2
        if at and nodes[at - 1][0] + nodes[at][0] < nodes[at][0] + nodes[at + 1][0]:
            at -= 1
        (f, left), (g, right) = nodes[at], nodes[at + 1]
        for leaf in left + right:
            depth[leaf] += 1
        nodes[at : at + 2] = [(f + g, left + right)]
    return depth


def ordered_codes(levels: list[int]) -> list[str]:
    """Bits of the leaves of an ordered tree with these depths, from the left."""
    out, code, before = [], 0, 0
    for level in levels:
        if out:
            code += 1
        code = code << (level - before) if level >= before else code >> (before - level)
        out.append(format(code, f"0{level}b"))
        before = level
    return out


def adjacent_prefix_code(histogram: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, value, frequency, level, bits: an order-preserving prefix code for each key; empty bins have none.

    A tree is built from at most a few hundred bins of a key in one grouped call.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frequency", "value"], ascending=[False, True])
        levels = adjacent_levels(rows["frequency"].tolist())
        return rows.assign(level=np.array(levels, np.int32), bits=ordered_codes(levels))

    used = histogram.where("frequency > 0").select(*keys, "value", "frequency")
    schema = used.select("*", F.lit(0).alias("level"), F.lit("").alias("bits")).schema
    return used.groupBy(*keys).applyInPandas(build, schema)


def pack_bits(bits: F.Column) -> F.Column:
    """A string of 0 and 1 as bytes, the first bit lowest in its byte, the last byte filled with zeros."""
    bytes_ = F.regexp_extract_all(F.rpad(bits, ((F.length(bits) + 7) / 8).cast("int") * 8, F.lit("0")), F.lit("(.{8})"), F.lit(1))
    return F.unhex(F.array_join(F.transform(bytes_, lambda b: F.lpad(F.conv(F.reverse(b), 2, 16), 2, "0")), ""))


def runs(lengths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, start, len, n: maximal runs of equal code lengths in symbol order (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy("sym")
    inner = Window.partitionBy(*keys, "len").orderBy("sym")
    island = F.row_number().over(order) - F.row_number().over(inner)
    return lengths.withColumn("island", island).groupBy(*keys, "len", "island").agg(F.min("sym").alias("start"), F.count("*").alias("n")).drop("island")


def run_length_symbols(run_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, start, part, symbol, times, extra_bits: runs of code lengths in the code-length alphabet.

    Zeros: 18 for up to 138, then 17 for 3 to 10, single zeros for fewer. Other lengths: the length once, then 16 for 3 to 6 more, singles for
    fewer. Runs are split greedily from the left; a rest too short to repeat is spelled out.
    """
    n, zero = F.col("n"), F.col("len") == 0
    single = lambda symbol, k: F.array_repeat(F.struct(symbol.cast("int").alias("symbol"), F.lit(1).alias("times"), F.lit(0).alias("extra_bits")), k.cast("int"))
    repeat = lambda symbol, times, bits: F.struct(F.lit(symbol).alias("symbol"), times.cast("int").alias("times"), F.lit(bits).alias("extra_bits"))
    whole, rest = F.floor(n / 138), n % 138
    zeros = F.concat(
        F.array_repeat(repeat(18, F.lit(138), 7), whole.cast("int")),
        F.when(rest >= 11, F.array(repeat(18, rest, 7))).when(rest >= 3, F.array(repeat(17, rest, 3))).otherwise(single(F.lit(0), rest)),
    )
    more = n - 1
    six, left = F.floor(more / 6), more % 6
    others = F.concat(
        single(F.col("len"), F.lit(1)),
        F.array_repeat(repeat(16, F.lit(6), 2), six.cast("int")),
        F.when(left >= 3, F.array(repeat(16, left, 2))).otherwise(single(F.col("len"), left)),
    )
    parts = run_rows.select(*keys, "start", F.posexplode(F.when(zero, zeros).otherwise(others)).alias("part", "s"))
    return parts.select(*keys, "start", "part", "s.symbol", "s.times", "s.extra_bits")


def expand_run_lengths(symbols: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The inverse of run_length_symbols: keys, sym, len."""
    order = Window.partitionBy(*keys).orderBy("start", "part")
    value = F.last(F.when(F.col("symbol") <= 15, F.col("symbol")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    length = F.when(F.col("symbol") >= 17, 0).otherwise(value)
    first = F.coalesce(F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = symbols.select(*keys, length.cast("int").alias("len"), first.alias("first"), "times")
    return rows.select(*keys, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)).alias("sym"), "len")


def block_header(lengths: DataFrame, final: bool = True) -> DataFrame:
    """final, type, hlit, hdist, hclen of a dynamic block from code lengths (alphabet litlen, dist or clen; sym; len)."""
    from chunkloom.functions.dims import CODE_LENGTH_ORDER

    place = F.array_position(F.array(*[F.lit(x) for x in CODE_LENGTH_ORDER]), F.col("sym"))
    last = lambda a: F.max(F.when((F.col("alphabet") == a) & (F.col("len") > 0), F.col("sym")))
    return lengths.agg(
        F.lit(final).alias("final"), F.lit(2).alias("type"),
        (F.greatest(F.coalesce(last("litlen"), F.lit(256)), F.lit(256)) - 256).alias("hlit"),
        F.coalesce(last("dist"), F.lit(0)).alias("hdist"),
        (F.greatest(F.coalesce(F.max(F.when((F.col("alphabet") == "clen") & (F.col("len") > 0), place)), F.lit(4)), F.lit(4)) - 4).cast("int").alias("hclen"),
    )
