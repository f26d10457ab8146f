"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """From edges (a, b) to (node, root), root being the least node reachable; only nodes with an edge to another appear.

    Large-star and small-star steps (Kiveris et al., 2014) in turn until nothing changes; each turn is a written table.
    Minima are found by partial aggregation and joined back, so that a hub's edges needn't meet in one task.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, turn, before = scratch.table(e, f"{name}0", narrow=True), 0, None
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        parts = least(large)
        small = parts.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(parts.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        new = scratch.table(small, f"{name}{turn}", narrow=True)
        scratch.drop(f"{name}{turn - 1}")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        e = new
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def forest_roots(parents: DataFrame, doublings: int = 3) -> DataFrame:
    """From (a, b), b being a's only parent and no cycle there: (node, root), root being the ancestor 2**doublings up or the last one below that."""
    up = parents.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(doublings):
        up = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return up
