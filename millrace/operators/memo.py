"""Memoisation of computations: remember, look up, expire, evict, and compute each key once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_TTL_S, NEGATIVE_TTL_S, MAX_ENTRIES = 30, 3, 10_000
STAGE_LIMIT = 64


def ttl_for(capability: Column, success: Column, overrides: Mapping[str, int] | None = None) -> Column:
    """Seconds that a result lives: short after a failure, else the capability's own or the default."""
    own = F.lit(DEFAULT_TTL_S)
    for name, seconds in (overrides or {}).items():
        own = F.when(capability == name, F.lit(seconds)).otherwise(own)
    return F.when(~success, F.lit(NEGATIVE_TTL_S)).otherwise(own)


def register(calls: DataFrame, key: str, seq: str, latency: str, output: str) -> DataFrame:
    """One row a key: how often it ran, the mean latency, and the last output."""
    return calls.groupBy(key).agg(F.count("*").alias("execution_count"), F.avg(latency).alias("avg_latency_ms"), F.max_by(output, seq).alias("output"))


def hit_or_miss(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every call with hit: whether an earlier one has its key."""
    w = Window.partitionBy(key).orderBy(*order)
    return calls.withColumn("hit", F.row_number().over(w) > 1)


def hit_within_ttl(calls: DataFrame, key: str, order: list[str], ts: str, ttl_s: Column) -> DataFrame:
    """Every call with hit: whether the call before it with its key is not yet expired."""
    w = Window.partitionBy(key).orderBy(*order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return calls.withColumn("hit", F.coalesce(micros - F.lag(micros).over(w) < ttl_s.cast("long") * 1_000_000, F.lit(False)))


def lru_survivors(calls: DataFrame, key: str, touch: list[str], capacity: int = MAX_ENTRIES) -> DataFrame:
    """The keys that a least-recently-used store of this capacity still holds; a top-k, not a sort of all keys."""
    last = calls.groupBy(key).agg(F.max(F.struct(*touch)).alias("last_touch"))
    return last.orderBy(F.col("last_touch").desc(), key).limit(capacity).select(key, *[F.col(f"last_touch.{c}").alias(c) for c in touch])


def running_latency(calls: DataFrame, key: str, order: list[str], latency: str) -> DataFrame:
    """Each call's place among its key's calls and their mean latency up to it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("execution_count", F.count("*").over(w)).withColumn("avg_latency_ms", F.avg(latency).over(w))


def compute_once(calls: DataFrame, key: str, inputs: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run `compute` on one call of each key and give all calls of the key its result columns."""
    distinct = calls.select(key, *inputs).dropDuplicates([key])
    return calls.join(compute(distinct).drop(*inputs), key)


def lookup(calls: DataFrame, memo: DataFrame, key: str, now: Column) -> DataFrame:
    """Calls with the unexpired remembered row of their key, or nulls."""
    return calls.join(memo.filter(F.col("expires_at") > now), key, "left")


def restore(calls: DataFrame, computed: DataFrame, key: str, state: str) -> DataFrame:
    """The remembered state where there is one, else the computed one, with a mark of where it is from."""
    fresh = computed.withColumnRenamed(state, "__fresh")
    out = calls.join(fresh, key, "left")
    return out.withColumn("from_shared", F.col(state).isNotNull()).withColumn(state, F.coalesce(state, "__fresh")).drop("__fresh")


def stage_hash(payload: Column, version: str = "v1") -> Column:
    """Full SHA-256 of a stage's input, which the producer's version is part of."""
    return F.sha2(F.concat(F.lit(version + ":"), payload), 256)


def stage_lookup(inputs: DataFrame, outputs: DataFrame, artifacts: DataFrame, stages: DataFrame, limit: int = STAGE_LIMIT) -> DataFrame:
    """Remembered artifacts of completed runs of a stage with this input, the latest first.

    inputs and outputs share run_id and stage_name, outputs name artifact_id, stages have completed_at.
    """
    joined = inputs.join(outputs, ["run_id", "stage_name"]).join(artifacts.filter(~F.col("deleted")), "artifact_id")
    done = joined.join(stages.filter(F.col("status") == "completed"), "run_id")
    return done.orderBy(F.col("completed_at").desc_nulls_last(), "run_id", "artifact_id", *[c for c in outputs.columns if c not in ("run_id", "artifact_id", "stage_name")]).limit(limit)


def stage_record(existing: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Insert-ignore: of each key the row that came first."""
    first = new.unionByName(existing).groupBy(*key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in key]), seq).alias("row"))
    return first.select(*key, "row.*")


def dedup_stats(calls: DataFrame, capability: str, key: str) -> DataFrame:
    """For each capability: distinct computations, reuses and their ratios; counted in two steps of partial sums."""
    per_key = calls.groupBy(capability, key).agg(F.count("*").alias("n"))
    return per_key.groupBy(capability).agg(
        F.count("*").alias("unique_computations"), F.sum(F.col("n") - 1).alias("total_reuses"),
        (F.sum(F.col("n") - 1) / F.greatest(F.count("*"), F.lit(1))).alias("dedup_ratio"), (F.sum(F.col("n") - 1) / F.greatest(F.sum("n"), F.lit(1))).alias("hit_ratio"),
    )


def persist(results: DataFrame, path: str, key: str, output: str, created: Column, ttl_s: Column) -> None:
    """Append results to the second level, a table of key, output, created_at and expires_at."""
    rows = results.select(F.col(key).alias("key"), F.col(output).cast("string").alias("output"), created.cast("timestamp").alias("created_at"), (created.cast("timestamp") + F.make_dt_interval(secs=ttl_s)).alias("expires_at"))
    rows.write.mode("append").parquet(path)


def hydrate(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """What the second level remembers at a time: of each key the last row, if it has not expired, with the seconds it has left."""
    rows = spark.read.parquet(path).filter(F.col("created_at") <= now)
    last = rows.groupBy("key").agg(F.max_by(F.struct("output", "created_at", "expires_at"), F.struct("created_at", "output")).alias("r")).select("key", "r.*")
    left = F.unix_micros("expires_at") - F.unix_micros(now)
    return last.filter(left > 0).withColumn("ttl_left_s", (left / 1_000_000).cast("long"))
