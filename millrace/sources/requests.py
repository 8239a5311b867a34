"""Tables of requests: reading, hibernating and waking them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What hibernation keeps of an envelope.
KEPT = ("id", "intent", "input", "state", "lifecycle", "parent_id")


def hibernate(rows: DataFrame, path: str) -> DataFrame:
    """Append the kept columns under `hib_` ids and return the ids."""
    kept = rows.select(F.concat(F.lit("hib_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("hib_id"), *KEPT)
    kept.write.mode("append").parquet(path)
    return kept.select("id", "hib_id")


def wake(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The rows of these ids (hib_id)."""
    return spark.read.parquet(path).join(ids, "hib_id", "left_semi")


def list_hibernated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("hib_id").distinct().orderBy("hib_id")


def probe(targets: DataFrame, fetch: Callable[[str], tuple[int, str]]) -> DataFrame:
    """ok, status_code and body of every url by an injected client; a failure is a row, never an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    code, body = fetch(url)
                    out.append((url, 200 <= code < 300, code, body))
                except Exception as e:
                    out.append((url, False, 0, str(e)))
            yield pd.DataFrame(out, columns=["url", "ok", "status_code", "body"])

    return targets.select("url").mapInPandas(run, "url string, ok boolean, status_code int, body string")
