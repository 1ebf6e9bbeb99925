"""Connected components of edge tables, without collecting any of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Each round gives every node its smallest neighbour as parent, follows parents to their end by doubling, and contracts
    the edges to those; a node with the smallest id of its component keeps itself, so the last parent is that node. A round at
    least halves the nodes of a component. The minimum is combined before its shuffle, so a hub costs a row per task.
    """
    left = materialise(edges.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b").distinct())
    levels = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            further = materialise(parent.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")))
            if further.filter("moved").isEmpty():
                break
            parent = further.select("node", "root")
        levels.append(parent)
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = materialise(left.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def deeper(known: DataFrame, level: DataFrame) -> DataFrame:
        level = level.select(F.col("node").alias("root"), F.col("root").alias("up"))
        return known.join(level, "root", "left").select("node", F.coalesce("up", "root").alias("root"))

    return reduce(deeper, levels[1:], levels[0])
