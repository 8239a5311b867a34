"""Key-value tables: an append-only Parquet log, read as its latest unexpired row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TTL_S = 86_400


class KeyValueTable:
    """save, load, delete, exists and list by prefix over a folder of Parquet files.

    Every write appends; deleted is a row too. The reader's order is (version, key); versions are the caller's.
    """

    SCHEMA = "key string, value string, version long, deleted boolean, expires_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, rows: DataFrame, version: int, ttl_s: int | None = None) -> None:
        """Append rows of key and value."""
        until = F.current_timestamp() + F.make_dt_interval(secs=F.lit(ttl_s)) if ttl_s else F.lit(None).cast("timestamp")
        rows.select("key", "value", F.lit(version).cast("long").alias("version"), F.lit(False).alias("deleted"), until.alias("expires_at")).write.mode("append").parquet(self.path)

    def delete(self, keys: DataFrame, version: int) -> None:
        gone = keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(version).cast("long").alias("version"), F.lit(True).alias("deleted"), F.lit(None).cast("timestamp").alias("expires_at"))
        gone.write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        """key and value of what is there now."""
        log = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = log.groupBy("key").agg(F.max_by(F.struct("value", "deleted", "expires_at"), "version").alias("r"))
        alive = ~F.col("r.deleted") & (F.col("r.expires_at").isNull() | (F.col("r.expires_at") > F.current_timestamp()))
        return last.filter(alive).select("key", "r.value")

    def get(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.load(), "key", "left")

    def exists(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.load().select("key"), "key", "left_semi")

    def list_keys(self, prefix: str = "") -> DataFrame:
        return self.load().filter(F.col("key").startswith(prefix)).select("key").orderBy("key")

    def compact(self, target: str) -> None:
        """Write the current rows as a log of its own."""
        self.load().select("key", "value", F.lit(0).cast("long").alias("version"), F.lit(False).alias("deleted"), F.lit(None).cast("timestamp").alias("expires_at")).write.parquet(target)


def read_json_store(spark: SparkSession, folder: str) -> DataFrame:
    """key and value of a folder of JSON files, one for each key."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(name.alias("key"), "value")


def read_jdbc_store(spark: SparkSession, url: str, table: str, prefix: str = "", **options: str) -> DataFrame:
    """key and value of a database table; the prefix is filtered by the database."""
    return spark.read.jdbc(url, table, properties=options).filter(F.col("key").startswith(prefix)).select("key", "value")


def write_jdbc_store(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Append rows to a database table; upserts are the latest row for each key on reading."""
    rows.write.jdbc(url, table, mode="append", properties=options)
