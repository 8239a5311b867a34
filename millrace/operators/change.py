"""Diffs of states, mutation timelines, replay, forks, watchers and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.routing import enrich

# Keys whose values are masked in logs.
SECRET_KEYS = ("password", "token", "secret", "api_key", "authorization")
MASK = "***REDACTED***"


def diff(before: Column, after: Column) -> Column:
    """A struct of added (map), removed (keys) and modified (map of before and after) between two maps."""
    b, a = F.coalesce(before, F.create_map().cast("map<string,string>")), F.coalesce(after, F.create_map().cast("map<string,string>"))
    added = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    removed = F.array_sort(F.array_except(F.map_keys(b), F.map_keys(a)))
    changed = F.map_filter(a, lambda k, v: F.map_contains_key(b, k) & ~v.eqNullSafe(F.try_element_at(b, k)))
    modified = F.transform_values(changed, lambda k, v: F.struct(F.try_element_at(b, k).alias("before"), v.alias("after")))
    return F.struct(added.alias("added"), removed.alias("removed"), modified.alias("modified"))


def step_diffs(states: DataFrame, by: str, order: str, state: str) -> DataFrame:
    """Each state's diff to the one before it, and to the first one."""
    w = Window.partitionBy(by).orderBy(order)
    first = F.first(state).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return states.withColumn("step", diff(F.lag(state).over(w), F.col(state))).withColumn("cumulative", diff(first, F.col(state)))


def mutations(values: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Every change of a key's value: old and new; a first value is a change from null."""
    old = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return values.withColumn("old", old).withColumnRenamed(value, "new").filter(~F.col("old").eqNullSafe(F.col("new")))


def mutation_keys(changes: DataFrame, by: str, key: str) -> DataFrame:
    """How many distinct keys changed, and how often."""
    per = changes.groupBy(by, key).agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.count("*").alias("keys"), F.sum("n").alias("changes"))


def replay_from(history: DataFrame, by: str, order: str, at: Column) -> DataFrame:
    """History up to the first entry that fits, that one excluded; nothing of a history where none fits."""
    first = history.filter(at).groupBy(by).agg(F.min(order).alias("__cut"))
    return history.join(first, by).filter(F.col(order) < F.col("__cut")).drop("__cut")


def fork(rows: DataFrame, node: str, state: str, patch: Column) -> DataFrame:
    """A copy of every row under a new id that names its parent, with the patch over its state."""
    return rows.withColumn("parent_id", F.col(node)).withColumn(node, F.concat(F.lit("fork_"), F.substring(F.sha2(F.col(node).cast("string"), 256), 1, 12))).withColumn(state, enrich(F.col(state), patch))


def snapshots(rows: DataFrame, label: str, node: str, seq: str) -> DataFrame:
    """Of each node's rows with a label the last: what restoring it gives."""
    cols = [F.col(c) for c in rows.columns if c not in (node, label)]
    return rows.groupBy(node, label).agg(F.max_by(F.struct(*cols), seq).alias("__row")).select(node, label, "__row.*")


def watch(events: DataFrame, ids: list | None = None, kinds: list[str] | None = None, node: str = "id", kind: str = "kind") -> DataFrame:
    """Events of these nodes and kinds; None stands for all."""
    out = events.filter(F.col(node).isin(ids)) if ids is not None else events
    return out.filter(F.col(kind).isin(kinds)) if kinds is not None else out


def redact(fields: Column) -> Column:
    """A map of log fields with the values of secret keys masked."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), F.lit(MASK)).otherwise(v))
