"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def _flatten(parents: DataFrame) -> DataFrame:
    """node -> root of its tree, by pointer jumping (a parent is smaller than its node, so there are no cycles)."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = materialize(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            ),
            "jump",
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b; longs): root is the smallest node it reaches.

    Each round hangs every node below its smallest smaller neighbour, flattens these trees, and contracts links to
    their roots. Hubs are no trouble: per node only a minimum is kept, computed before rows are dealt out. Rounds go
    as the logarithm of the longest chain of local minima.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    live = materialize(oriented(links), "links")
    total = None
    while not live.isEmpty():
        roots = _flatten(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        if total is None:
            total = roots
        else:
            step = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            moved = total.join(step, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
            fresh = roots.join(total.select("node"), "node", "left_anti")
            total = materialize(moved.unionByName(fresh), "roots")
        for side in ("a", "b"):
            step = roots.select(F.col("node").alias(side), F.col("parent").alias("root"))
            live = live.join(step, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        live = materialize(oriented(live), "links")
    if total is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return total.select("node", F.col("parent").alias("root"))
