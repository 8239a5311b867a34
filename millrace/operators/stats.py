"""Statistics over executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.keys import nearest_rank


# Bucket bounds in seconds of node and of pipeline durations.
NODE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
PIPELINE_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def latency_percentiles(calls: DataFrame, by: str, latency: str, levels: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles, mean and count of a group's latencies.

    Latencies are counted by ranges half a percent wide first, a few thousand for a group; only the ranges that the wanted ranks
    fall into are then counted value by value. So no task sorts a group, however large.
    """
    x = F.col(latency).cast("double")
    size = F.abs(x)
    place = F.floor(F.log(size) * 200).cast("long") + 1_000_000  # grows with the value, as the logarithm does
    kept = calls.filter(F.col(latency).isNotNull()).withColumn(
        "__range", F.when(F.isnan(x), F.lit(4_000_000)).when(size == float("inf"), F.signum(x).cast("long") * 3_000_000).when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * place).cast("long")
    )
    ranges = kept.groupBy(by, "__range").agg(F.count("*").alias("__c"), F.sum(latency).alias("__s"))
    ordered = Window.partitionBy(by).orderBy("__range")
    ranges = ranges.withColumn("__before", F.sum("__c").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c"))
    whole = Window.partitionBy(by)
    ranges = ranges.withColumn("__n", F.sum("__c").over(whole)).withColumn("__avg", F.sum("__s").over(whole) / F.sum("__c").over(whole))
    ranks = F.array(*[F.bround(F.lit(p) * (F.col("__n") - 1)).cast("long") for p in levels])
    wanted = ranges.select("*", F.posexplode(ranks).alias("__level", "__rank")).filter((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__c")))
    values = kept.join(wanted.select(by, "__range").distinct(), [by, "__range"]).groupBy(by, "__range", latency).agg(F.count("*").alias("__k"))
    values = values.withColumn("__upto", F.sum("__k").over(Window.partitionBy(by, "__range").orderBy(latency).rowsBetween(Window.unboundedPreceding, 0)))
    found = wanted.join(values, [by, "__range"]).filter(F.col("__upto") > F.col("__rank") - F.col("__before")).groupBy(by, "__level").agg(F.min(latency).alias("__v"), F.first("__avg").alias("__avg"), F.first("__n").alias("__n"))
    at = [F.min(F.when(F.col("__level") == i, F.col("__v"))).alias(f"p{round(p * 100)}") for i, p in enumerate(levels)]
    return found.groupBy(by).agg(*at, F.first("__avg").alias("avg"), F.first("__n").alias("count"))


def small_percentile(values: Column, p: float) -> Column:
    """The same over an array column."""
    return nearest_rank(F.sort_array(values), p)


def usefulness(steps: DataFrame, warm: Column, useful: Column) -> DataFrame:
    """Shares of warm and of useful steps, and steps saved downstream."""
    return steps.agg(F.avg(warm.cast("double")).alias("warm_rate"), F.avg(useful.cast("double")).alias("useful_rate"), F.sum(warm.cast("long")).alias("downstream_saved"))


def execution_patterns(calls: DataFrame, intent: str, path: str, success: str, latency: str) -> DataFrame:
    """Per intent: runs, successes, latencies and the path that is most common (the first in order of ties)."""
    per_path = calls.groupBy(intent, path).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("long")).alias("s"), F.sum(latency).alias("l"))
    out = per_path.groupBy(intent).agg(
        F.sum("n").alias("executions"), F.sum("s").alias("successes"), F.sum("l").alias("total_latency"), F.min(F.struct(-F.col("n"), F.col(path).alias("p"))).alias("top")
    )
    rate = (F.col("successes") / F.col("executions")).alias("success_rate")
    return out.select(intent, "executions", "successes", (F.col("total_latency") / F.col("executions")).alias("avg_latency"), rate, F.col("top.p").alias("common_path"))


def performance_report(calls: DataFrame, path: str, success: str, latency: str) -> DataFrame:
    """Per path: executions, mean latency and success rate."""
    return calls.groupBy(path).agg(F.count("*").alias("executions"), F.avg(latency).alias("avg_latency"), F.avg(F.col(success).cast("double")).alias("success_rate"))


def rolling_mean(calls: DataFrame, by: str, order: list[str], value: str, rows: int = 100) -> DataFrame:
    """Each call with the mean of its group's last `rows` values."""
    return calls.withColumn("rolling_avg", F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - rows, 0)))


def histogram(calls: DataFrame, by: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative bucket counts: how many values of each group are at most each bound; the last bound is infinite."""
    counts = [F.sum((F.col(value) <= b).cast("long")).alias(f"n{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"n{len(bounds)}")]
    wide = calls.groupBy(by).agg(*counts)
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"n{i}").alias("n")) for i, b in enumerate([*bounds, "+Inf"])])
    return wide.select(by, F.explode(rows).alias("x")).select(by, "x.le", "x.n")


def majority(votes: DataFrame, by: str, vote: str) -> DataFrame:
    """The majority's decision (a tie is a no), unanimity and counts."""
    yes, n = F.sum(F.col(vote).cast("long")), F.count(vote)
    return votes.groupBy(by).agg(yes.alias("yes"), n.alias("votes"), (yes * 2 > n).alias("decision"), ((yes == n) | (yes == 0)).alias("unanimous"))


def merge_confidence(rows: DataFrame, by: str, seq: str, confidence: str, value: str) -> DataFrame:
    """Partial results of one request merged: mean and highest confidence, the last value and that of the most confident (the first of ties)."""
    return rows.groupBy(by).agg(
        F.avg(confidence).alias("average"), F.max(confidence).alias("highest"), F.max_by(value, seq).alias("union_value"),
        F.max_by(value, F.struct(F.col(confidence), -F.col(seq))).alias("highest_value"),
    )


def tenant_usage(calls: DataFrame, tenant: str, cost: str, quota: int) -> DataFrame:
    """Additive counters of each tenant and whether it is still within its quota of requests."""
    return calls.groupBy(tenant).agg(F.count("*").alias("requests"), F.sum(cost).alias("compute"), (F.count("*") < quota).alias("within_quota"))
