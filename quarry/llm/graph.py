"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is DataFrame joins and aggregations with partial sums; each round is cut
by a checkpoint in the shared folder. Labels are the smallest node of a component.
Nodes may be of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Least neighbours of up to this many edges are broadcast (two rows an edge, some 50 bytes each).
BROADCAST_EDGES = 100_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One step over (a, b), a > b: every node points its larger (or smaller) neighbours to the least of its neighbourhood.

    Beyond ``few`` edges the join has an exchange on both sides, so that adaptive execution can split a node of many neighbours.
    """
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(F.broadcast(least) if few else least.repartition("u"), "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the (a, b) edges; component is its smallest node."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        few = mark[0] <= BROADCAST_EDGES
        now = _star(_star(now, True, few), False, few).distinct().checkpoint()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, component) after more edges: only components that an edge joins are looked at again."""
    if edges.isEmpty():
        return labels
    known = lambda end: F.coalesce(F.col(f"{end}_part"), F.col(end)).alias(end)
    for end in "ab":
        edges = edges.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
    joined = components(edges.select(known("a"), known("b"))).select(F.col("node").alias("component"), F.col("component").alias("root")).checkpoint()
    old = labels.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = joined.join(labels.select(F.col("node").alias("component")), "component", "left_anti")
    return old.unionByName(fresh.select(F.col("component").alias("node"), F.col("root").alias("component")))
