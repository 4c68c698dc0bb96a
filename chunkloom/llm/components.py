"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import stored


def local_forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of 0..n-1 reaches over the edges."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


#: A node's edges are dealt to so many tasks, so that a hub's do not meet in one.
DEALS = 16


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m of least (a, m). least has a row for each node and is repeated for each deal of its edges."""
    dealt = edges.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(DEALS)).cast("int"))
    repeated = least.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return dealt.join(repeated, ["a", "deal"]).drop("deal")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down (a > b), and its end has none: then that end is the smallest of its component."""
    several = edges.groupBy("a").count().where("count > 1").select(F.lit(1).alias("x"))
    inner = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")).distinct(), "b").select(F.lit(1).alias("x"))
    return several.unionByName(inner).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: every node of edges (a, b, both long and not null) but the roots, with the smallest node it reaches.

    Each round is two aggregations and two joins with partial sums and skew handling by the engine, and ends in a written table. Rounds go
    with the logarithm of the number of nodes; they end when all components are stars around their smallest nodes. Nothing but one flag a
    round reaches the driver.
    """
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _all_stars(state):
            break
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
