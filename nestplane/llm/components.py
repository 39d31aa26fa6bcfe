"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Edges stay in Spark; each round is two aggregations that combine before the shuffle and two joins
against one row per node, which spread the edges of a hub (``beside``). The table of a round is written to the shared folder, so a lost executor
costs a task, and lineage does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestplane.llm.joins import beside
from nestplane.sources.shared import Workspace


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """``(node, component)`` of every node that has an edge ``(a, b)``; the component is its smallest node.

    Loops and repeated edges are harmless. No edges give an empty table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, step = space.write(pairs, "edges"), 0
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = beside(both, low, ["u"], ["v"], number=2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = beside(large, least, ["u"], ["v"], number=2 * mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
        before, step = now, step + 1
        now = space.write(small, f"stars{step}")
        was, mark = mark, _mark(now)
        space.drop(before)
        if mark == was:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
