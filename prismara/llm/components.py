"""Connected components of an edge table by rounds of contraction, wholly in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut


def _rank(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), node.alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges (two long columns); root is one node of its component.

    Each round, every node points to the neighbour (or itself) with the least random rank and the edges are
    contracted along these pointers. Ranks are drawn anew each round, so long paths shrink by a constant
    share as well as stars do. Edges and pointers live in the shared checkpoint folder between rounds; the
    driver sees only whether edges are left. Loops, repeated edges and both directions are fine; edges with
    a null end are ignored; an empty table gives an empty one.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = cut(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes, turn = None, 0
    while turn == 0 or not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        best = both.groupBy("u").agg(F.min(_rank(F.col("v"), turn)).alias("m"))
        step = cut(best.select("u", F.least("m", _rank(F.col("u"), turn))["v"].alias("p")))
        if nodes is None:
            nodes = step.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            nodes = nodes.join(step, nodes["root"] == step["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
            nodes = cut(nodes)
        ends = left.join(step.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
        ends = ends.join(step.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        ends = ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left, turn = cut(ends.distinct()), turn + 1
    return nodes


def extended(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, root), as connected_components gives them, when edges(a, b) are added: components are found among
    roots and new nodes alone, so earlier edges aren't walked again."""
    ends = edges.select("a", "b")
    for x in "ab":
        known = nodes.select(F.col("node").alias(x), F.col("root").alias("to"))
        ends = ends.join(known, x, "left").withColumn(x, F.coalesce("to", x)).drop("to")
    roots = connected_components(ends).select(F.col("node").alias("r"), F.col("root").alias("to"))
    fresh = roots.join(nodes.select(F.col("node").alias("r")), "r", "left_anti").select(F.col("r").alias("node"), F.col("r").alias("root"))
    both = nodes.union(fresh)
    return cut(both.join(roots, both["root"] == roots["r"], "left").select("node", F.coalesce("to", "root").alias("root")))
