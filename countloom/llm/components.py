"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum joined back to the edges, so a hub with very many neighbours is pre-aggregated and
then met by a join whose partitions Spark can split; no neighbour list is ever gathered. Every round is cut into a
table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countloom.session import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (a > b)."""
    if small:  # every node's smaller neighbours, and the node itself, go to the smallest of them
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.col("b").alias("x"), "m").unionByName(low.select(F.col("a").alias("x"), "m"))
    else:  # every node's larger neighbours go to its smallest neighbour (or itself)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = edges.select(F.col("b").alias("u"), F.col("a").alias("x"))
        out = up.join(low, "u").select("x", "m")
    return out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for each node of an edge: root is the smallest node of its component. Self loops are ignored."""
    x, y = F.col(left), F.col(right)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    seen = _sum(now)
    while seen[0]:
        now = cut(_star(_star(now, False), True), "edges")
        was, seen = seen, _sum(now)
        if was == seen:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
