"""Minimax contiguous sharding of atomic groups, in DataFrame functions only.

Groups (equal texts) stand in the order of their digests. The smallest feasible capacity of a shard is found by binary search; each
capacity is checked greedily on prefix sums. The prefix sums stay distributed: the driver sees sums of at most some 100,000 cells of the
digest space and splits only those cells that a cut could fall into, six bits at a time, until both bounds of the capacity meet.

The order of the groups is part of this law: groups at least as large as the mean of what is left come first, the largest of all before the
others, each in a shard of its own (it could not share one without making it the largest); the rest follows in the order of digests and
is dealt to the other shards. So one huge group does not leave shards empty.

Cases: a null text counts as no byte and belongs to the group of the empty text; null and repeated ids are rows like any other; with
fewer groups than shards, shards stay empty; an empty table gives no row; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import cut

ROW_BYTES = 16
#: Rows of the whole table for each salt, and least number of salts: a group of a third of all rows gives each of its parts a third of these.
ROWS_PER_SALT, LEAST_SALTS = 1 << 20, 64
FIRST_BITS, STEP_BITS, KEY_BITS = 12, 6, 60


@dataclass(frozen=True)
class Cell:
    """Groups whose key starts with prefix (of so many bits): the prefix sums after its last, and how many there are."""

    prefix: int
    bits: int
    end: int
    end_rows: int
    groups: int


def greedy(cells: list[Cell], capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Where each shard ends when it takes what fits. hopeful: as if a cell of several groups could be cut anywhere."""
    ends, cuts, x = [c.end for c in cells], [], 0
    for _ in range(shards):
        limit = x + capacity
        at = bisect_right(ends, limit)
        if at == len(ends):
            x = ends[-1]
        elif hopeful and cells[at].groups > 1:
            x = max(x, min(limit, ends[at] - 1))
        else:
            x = max(x, ends[at - 1] if at else 0)
        cuts.append(x)
    return cuts


def least_capacity(cells: list[Cell], low: int, shards: int, hopeful: bool) -> int:
    high = total = cells[-1].end
    while low < high:
        middle = (low + high) // 2
        if greedy(cells, middle, shards, hopeful)[-1] == total:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(cells: list[Cell], capacity: int, shards: int) -> list[int]:
    """Cuts that keep to the capacity, each as near as known ends allow to an even share of what is left.

    A cut is taken only if greedy filling can still place the rest; else the shard takes all that fits, as the greedy check does.
    """
    ends, cuts, x = [c.end for c in cells], [], 0
    fits = lambda start, left: start == ends[-1] or (left > 0 and _fill(ends, start, capacity, left) == ends[-1])
    for left in range(shards - 1, -1, -1):
        wanted = x + (ends[-1] - x) / (left + 1)
        at = bisect_right(ends, wanted)
        near = sorted((e for e in ends[max(0, at - 1) : at + 1] if x < e <= x + capacity), key=lambda e: abs(e - wanted))
        x = next((e for e in near if fits(e, left)), _fill(ends, x, capacity, 1))
        cuts.append(x)
    return cuts


def _fill(ends: list[int], x: int, capacity: int, shards: int) -> int:
    for _ in range(shards):
        at = bisect_right(ends, x + capacity)
        x = max(x, ends[at - 1] if at else 0)
    return x


def minimax_cuts(groups: DataFrame, largest: int, shards: int) -> tuple[list[int], list[int]]:
    """Prefix sums of size and rows at the ends of the shards. groups: key (60 bits), end, end_rows in key order."""

    def cells_of(parents: list[Cell], bits: int) -> list[Cell]:
        prefix = lambda b: F.shiftright("key", KEY_BITS - b)
        rows = groups if not parents else groups.where(prefix(parents[0].bits).isin([c.prefix for c in parents]))
        found = rows.groupBy(prefix(bits).alias("p")).agg(F.max("end").alias("e"), F.max("end_rows").alias("r"), F.count("*").alias("n")).collect()
        return [Cell(x.p, bits, x.e, x.r, x.n) for x in found]

    cells = sorted(cells_of([], FIRST_BITS), key=lambda c: c.end)
    if not cells:
        return [0] * shards, [0] * shards
    least = max(largest, -(-cells[-1].end // shards))
    while True:
        low, high = least_capacity(cells, least, shards, True), least_capacity(cells, least, shards, False)
        if low == high:
            break
        ranges = list(zip(greedy(cells, low, shards, False), greedy(cells, high, shards, True), strict=True))
        starts = [0, *(c.end for c in cells[:-1])]
        open_cells = [c for c, s in zip(cells, starts, strict=True) if c.groups > 1 and c.bits < KEY_BITS and any(a <= c.end and b >= s for a, b in ranges)]
        if not open_cells:
            break
        finer = [x for bits in {c.bits for c in open_cells} for x in cells_of([c for c in open_cells if c.bits == bits], min(KEY_BITS, bits + STEP_BITS))]
        cells = sorted([*(set(cells) - set(open_cells)), *finer], key=lambda c: c.end)
    cuts = even_cuts(cells, high, shards)
    rows_at = {0: 0} | {c.end: c.end_rows for c in cells}
    return cuts, [rows_at[x] for x in cuts]


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), at + 1)


def shard_groups(rows: DataFrame, shards: int) -> DataFrame:
    """group, salt, shard, base (slots before this part of the group) for rows (group, salt, size)."""
    sums = cut(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    totals = sums.agg(F.sum("bytes")).first()[0] or 0
    own: list[tuple[bytes, int]] = []
    for top in sums.orderBy(F.desc("bytes"), "group").limit(shards).select("group", "bytes").collect():
        largest, left = top.bytes, shards - len(own)
        if left == 1 or largest * left < totals:
            break
        own.append((bytes(top.group), largest))
        totals -= largest
        largest = 0
    else:
        largest = 0
    alone = [F.col("group") == F.lit(g) for g, _ in own]
    lonely = alone[0] if alone else F.lit(False)
    for x in alone[1:]:
        lonely = lonely | x
    keyed = sums.where(~lonely).withColumn("key", F.conv(F.substring(F.hex("group"), 1, KEY_BITS // 4), 16, 10).cast("long"))
    keyed = keyed.withColumn("bucket", F.shiftright("key", KEY_BITS - FIRST_BITS))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** FIRST_BITS rows
    offsets = keyed.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
    offsets = offsets.select("bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    within = Window.partitionBy("bucket").orderBy("key", "group").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.select("*", F.sum("bytes").over(within).alias("b1"), F.sum("n").over(within).alias("r1")).join(F.broadcast(offsets), "bucket")
    placed = cut(placed.select("group", "key", "n", (F.col("b0") + F.col("b1")).alias("end"), (F.col("r0") + F.col("r1")).alias("end_rows")))
    cuts, cut_rows = minimax_cuts(placed, largest, shards - len(own))
    at = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    dealt = placed.withColumn("at", at).select("group", (F.col("at") + len(own)).cast("int").alias("shard"), (F.col("end_rows") - F.col("n") - _pick([0, *cut_rows], F.col("at"))).alias("slots"))
    for i, condition in enumerate(alone):
        dealt = dealt.unionByName(sums.where(condition).select("group", F.lit(i).alias("shard"), F.lit(0).cast("long").alias("slots")))
    parts = rows.groupBy("group", "salt").agg(F.count("*").alias("k"))
    earlier = Window.partitionBy("group").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as salts
    return parts.withColumn("k0", F.coalesce(F.sum("k").over(earlier), F.lit(0))).join(dealt, "group").select("group", "salt", "shard", (F.col("slots") + F.col("k0")).alias("base"))


def shard_documents(documents: DataFrame, shards: int = 40, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; sizes of shards are near equal (law bytes).

    Texts are read once and never shuffled: digests, sizes and checksums go on. A group's rows are split by a salt before any sort, so that
    many tasks number a group of a third of all rows; salts grow with the table. Rows without an id are dealt by their place in the input.
    """
    text = F.coalesce("text", F.lit(""))
    slim = cut(
        documents.select(
            "doc_id",
            (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
            F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id")).alias("deal"),
        )
    )
    salts = max(LEAST_SALTS, slim.count() // ROWS_PER_SALT)
    slim = slim.withColumn("salt", F.pmod("deal", F.lit(salts)).cast("int")).drop("deal")
    places = shard_groups(slim, shards)
    rank = F.row_number().over(Window.partitionBy("group", "salt").orderBy("doc_id")) - 1
    joined = slim.withColumn("rank", rank).join(places, ["group", "salt"])
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
