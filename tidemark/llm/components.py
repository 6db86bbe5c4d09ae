"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a, b`` longs): root is the smallest node reachable.

    Contraction in rounds: each node points to its smallest neighbour if that is smaller
    than itself, the pointers are followed a few steps, and the edges are rewritten to the
    nodes pointed to.  What stays is the graph of the roots found so far, which shrinks by
    a factor each round; a long chain needs a logarithmic number of rounds.  A node with
    very many edges is only ever aggregated (with a map-side part) or looked up in a join
    whose sides are both plain scans, which adaptive execution can split.
    Loops and repeated edges are harmless; a null end drops the edge; no edges give no rows.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    live = scratch.keep(both, "edges")
    roots = None
    while True:
        ends = live.select("b", "a").groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "node")
        steps = scratch.keep(ends, "steps")
        if roots is not None and steps.isEmpty():
            return roots
        for _ in range(2):
            on = steps.select(F.col("node").alias("to"), F.col("to").alias("next"))
            further = scratch.keep(steps.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "steps")
            scratch.drop(steps)
            steps = further
        if roots is None:
            all_nodes = live.select(F.col("a").alias("root")).union(live.select(F.col("b").alias("root"))).distinct()
            known = all_nodes.select(F.col("root").alias("node"), "root")
        else:
            known = roots
        moved = scratch.keep(known.join(steps.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = live.join(steps.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a", "left").select(F.coalesce("ta", "a").alias("a"), "b")
        right = left.join(steps.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b", "left").select("a", F.coalesce("tb", "b").alias("b"))
        rest = scratch.keep(right.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "edges")
        for old in (live, steps, *([roots] if roots is not None else [])):
            scratch.drop(old)
        live, roots = rest, moved
