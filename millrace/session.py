"""Session settings that the operators rely on."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # map updates replace earlier values
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with these settings; the caller's come last."""
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a local folder serves a local master; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/millrace-checkpoints"
    return posixpath.join(folder, f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: write it as a table in the shared folder and read that. The table goes when the driver ends.

    The planner knows a table's size; the estimates that checkpoints carry multiply over rounds of joins until planning stalls.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
