"""Choosing among alternatives: the first success, the cluster nearest to the data, the best node by cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BRANCHES, TIMEOUT_MS = 4, 5000


def split_branches(requests: DataFrame, capabilities: Column, most: int = MAX_BRANCHES) -> DataFrame:
    """One row for each of the first `most` capabilities of a request."""
    return requests.select("*", F.posexplode(F.slice(capabilities, 1, most)).alias("branch", "branch_capability"))


def first_success(branches: DataFrame, request: str, duration: str, success: str, state: str, seq: str, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """Of a request's branches the successful one that took least, within the timeout."""
    good = branches.filter(F.col(success) & (F.col(duration) <= timeout_ms))
    best = good.groupBy(request).agg(F.min(F.struct(duration, seq, state)).alias("w"))
    return best.select(request, F.col(f"w.{state}").alias("winner"), F.col(f"w.{duration}").alias("duration"))


def best_cluster(locations: DataFrame, request: str, cluster: str, data_weight: float = 1.0, capability_weight: float = 0.5) -> DataFrame:
    """The cluster of the highest score: located data items and preferred capabilities; rows say which by `kind`."""
    weight = F.when(F.col("kind") == "data", data_weight).otherwise(capability_weight)
    scores = locations.groupBy(request, cluster).agg(F.sum(weight).alias("score"))
    best = scores.groupBy(request).agg(F.min(F.struct(-F.col("score"), F.col(cluster).alias("c"))).alias("b"))
    return best.select(request, F.col("b.c").alias("best_cluster"), (-F.col("b.col1")).alias("score"))


def cost_score(mode: str, latency: str = "latency", cost: str = "cost", reliability: str = "reliability") -> Column:
    """What a mode minimises."""
    if mode == "fastest":
        return F.col(latency)
    if mode == "cheapest":
        return F.col(cost)
    return F.col(latency) * 0.4 + F.col(cost) * 100 * 0.3 + (1 - F.col(reliability)) * 100 * 0.3


def select_by_cost(nodes: DataFrame, by: str, node: str, mode: str) -> DataFrame:
    """The node of the least score in each group; the smaller name wins a tie."""
    best = nodes.groupBy(by).agg(F.min(F.struct(cost_score(mode).alias("score"), F.col(node).alias("node"))).alias("b"))
    return best.select(by, F.col("b.node").alias("node"), F.col("b.score").alias("score"))


def migration_log(moves: DataFrame, item: str, order: list[str], place: str) -> DataFrame:
    """From and to of every move of an item; its first place is no move."""
    before = F.lag(place).over(Window.partitionBy(item).orderBy(*order))
    return moves.withColumn("from_node", before).withColumnRenamed(place, "to_node").filter(F.col("from_node").isNotNull() & (F.col("from_node") != F.col("to_node")))
