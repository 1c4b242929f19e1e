"""Distributed union-find: connected components by alternating large-star and small-star steps.

Every step is a minimum over a node's neighbours (combined before the shuffle) and a join back; each round's forest
is written to shared storage, so nothing grows with the number of rounds and a lost executor costs one round at most.
Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.session import discard, settle, staged


def _round(forest: DataFrame) -> DataFrame:
    """One large-star and one small-star step; the forest before it is deleted."""
    both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = staged(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    new = staged(small)
    discard(forest, large)
    return new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node. Loops and repeats are harmless; no edges: no rows."""
    forest = staged(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        forest = _round(forest)
        settle(edges.sparkSession)
        now = forest.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(forest.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b): only the components that these touch are joined again."""
    left, right = (joined.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in "ab")
    again = components(links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = joined.join(again.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    alone = again.join(joined.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("least", "component").alias("component")).unionByName(alone)
