"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import cut_lineage

#: Tasks over which one node's edges are dealt at most.
SALTS = 256


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(pairs: DataFrame) -> DataFrame:
    """Every pair (u, v) with the smallest v of its u as m.

    Pairs are joined by (u, a salt of v), and the minimum goes to those salts only that a node's pairs have: a hub is dealt
    over ``SALTS`` tasks, while a node of one edge is sent once.
    """
    spread = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = spread.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    return spread.join(least.select("u", "m", F.explode("s").alias("s")), ["u", "s"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge table; the component is its smallest node.

    Nodes are of any type that has an order. Each round is two aggregations and two equi-joins over an edge table that
    only shrinks; rounds grow with the logarithm of the longest path, and end when the table stays as it is. Edge tables
    are checkpointed after each round, so a lost executor costs one round at most. Self-loops and repeated edges are
    allowed; an empty table gives no rows.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = _signature(e)
    while before[0]:
        both = _with_least(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        e = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        own = _with_least(e)
        e = own.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut_lineage(e)
        after = _signature(e)
        if after == before:
            break
        before = after
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
