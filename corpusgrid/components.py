"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.session import stage, unstage


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: component is the smallest node reachable over the edges. Isolated nodes do not appear.

    Every step is a grouped minimum and a join; steps repeat until the edges no longer change, about log(n) times, each
    cut from its lineage by files in the shared folder. Loops and repeated edges, nulls and an empty table are fine
    (edges with a null end are ignored).
    """
    big, small = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    edges = stage(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(big.alias("a"), small.alias("b")).where("a <> b").distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        # large star: every larger neighbour of a node joins the node's smallest neighbour (or the node)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large")
        # small star: a node and its smaller neighbours join the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, stage(rest.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "small")
        unstage(old, large)
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
