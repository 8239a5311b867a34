"""Partition, map and reduce over items: every partition is run exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.keys import md5_mod


def workers(spark: SparkSession, template: str, n: int) -> DataFrame:
    """Rows for n workers of a template capability."""
    return spark.range(n).select(F.concat(F.lit("swarm_worker_"), F.col("id")).alias("worker_id"), F.col("id").cast("int").alias("worker"), F.lit(template).alias("capability"))


def dense_index(items: DataFrame, order: str) -> DataFrame:
    """Items with their place (from 0) in the order of an integer column, without a sort in one task.

    Ranges are counted first; each item's place is its range's offset and its rank within the range.
    """
    spread = items.withColumn("__range", F.floor(F.col(order) / 1024))
    counts = spread.groupBy("__range").agg(F.count("*").alias("n"))
    # offsets over ranges of ranges, so that the windows stay small
    coarse = counts.withColumn("__top", F.floor(F.col("__range") / 1024))
    tops = coarse.groupBy("__top").agg(F.sum("n").alias("t"))
    tops = tops.withColumn("__before", F.coalesce(F.sum("t").over(Window.orderBy("__top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("__top").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.join(tops, "__top").withColumn("__offset", F.col("__before") + F.coalesce(F.sum("n").over(within), F.lit(0))).select("__range", "__offset")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return spread.withColumn("__rank", rank).join(offsets, "__range").withColumn("index", F.col("__offset") + F.col("__rank")).drop("__range", "__rank", "__offset")


def round_robin(items: DataFrame, order: str, n: int) -> DataFrame:
    """Items dealt in turn to n partitions in the order of a column."""
    return dense_index(items, order).withColumn("part", (F.col("index") % n).cast("int"))


def hash_partition(items: DataFrame, payload: Column, n: int) -> DataFrame:
    """Items dealt by the MD5 of their payload's text, all 128 bits."""
    return items.withColumn("part", md5_mod(payload, n))


def map_reduce(items: DataFrame, part: Column, value: str) -> DataFrame:
    """Each partition's sum and count; their reduction is one more aggregation."""
    return items.groupBy(part.alias("part")).agg(F.sum(value).alias("partition_result"), F.count("*").alias("items"))


class FailedItems(Exception):
    """Raised by a function that knows which items of its batch fail: a message for each of these, null for the others."""

    def __init__(self, messages: pd.Series):
        super().__init__("items failed")
        self.messages = messages


def guarded_map(items: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], schema: str) -> DataFrame:
    """Rows with result and error: a failure stays its own.

    Items that FailedItems names are set apart together and the rest is mapped again. A batch that fails in any other
    way is halved until the items that fail are alone, which takes about a call for each item if many fail.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], np.full(len(batch), None, object)
            todo = [np.arange(len(batch))] if len(batch) else []
            while todo:
                own = todo.pop()
                rows = batch if len(own) == len(batch) else batch.take(own)
                try:
                    results.append(pd.Series(np.asarray(fn(rows)), own))
                    continue
                except FailedItems as e:
                    failed = pd.notna(e.messages).to_numpy()
                    if len(failed) == len(own) and failed.any():
                        errors[own[failed]] = e.messages.to_numpy()[failed]
                        todo += [own[~failed]] if not failed.all() else []
                        continue
                    error = str(e)
                except Exception as e:
                    error = str(e)
                if len(own) == 1:
                    errors[own] = error
                else:
                    todo += [own[len(own) // 2 :], own[: len(own) // 2]]
            found = pd.concat(results).reindex(np.arange(len(batch))) if results else None
            yield batch.assign(result=None if found is None else found.to_numpy(), error=errors)

    return items.mapInPandas(run, schema)


def shared_map(items: DataFrame, fn: Callable[[pd.DataFrame, Mapping], pd.DataFrame], shared: Mapping, schema: str) -> DataFrame:
    """Rows mapped batch by batch by a function that also sees a shared state: a small mapping that all workers of this call read."""
    state = items.sparkSession.sparkContext.broadcast(dict(shared))  # as small as the driver's mapping

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch, state.value)

    return items.mapInPandas(run, schema)


def status(items: DataFrame, part: str, order: str, done: Column) -> DataFrame:
    """Of each partition: how many items, how many are done, the first and the last one, and whether it is finished."""
    counts = items.groupBy(part).agg(F.count("*").alias("items"), F.sum(done.cast("long")).alias("done"), F.min(order).alias("first_item"), F.max(order).alias("last_item"))
    return counts.withColumn("finished", F.col("items") == F.col("done"))


def error_rate(results: DataFrame, error: Column) -> DataFrame:
    """Workers, errors and their share."""
    return results.agg(F.count("*").alias("worker_count"), F.sum(error.cast("long")).alias("error_count"), F.avg(error.cast("double")).alias("error_rate"))


def collected_rows(results: DataFrame, part: str, order: str, value: str, ok: Column) -> DataFrame:
    """The successful values, a row each, sorted by partition and order; a large partition is many tasks' work."""
    good = results.filter(ok & F.col(value).isNotNull()).select(part, order, value)
    return good.repartitionByRange(part, order).sortWithinPartitions(part, order)
