"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of an edge; self-loops and repeats don't matter.

    Every round is a few joins and aggregations with partial sums, and ends in a checkpoint. The number
    of rounds grows with the logarithm of the longest chain. A node's edges are never gathered.
    """
    e = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null").distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v"))
    labels = checkpoint(nodes.groupBy("node").agg(F.min("node").alias("component")))
    if labels.isEmpty():
        return labels
    e = e.filter("u <> v")
    for _ in range(max_rounds):
        # the smallest label around each node, itself included
        lu = labels.select(F.col("node").alias("u"), F.col("component").alias("lu"))
        lv = labels.select(F.col("node").alias("v"), F.col("component").alias("lv"))
        linked = e.join(lu, "u").join(lv, "v").select("u", "v", "lu", "lv", F.least("lu", "lv").alias("low"))
        # hook the larger label's root under the smaller one, then follow four hooks from each label
        hooks = linked.filter("lu <> lv").select(F.greatest("lu", "lv").alias("node"), F.col("low").alias("component"))
        hooks = checkpoint(hooks.groupBy("node").agg(F.min("component").alias("component")))
        if hooks.isEmpty():
            return labels
        up = hooks.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        for _ in range(4):  # joins of one table, which is sent once where it is small; self-joins of hooks make larger plans
            labels = labels.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
        labels = checkpoint(labels)
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
