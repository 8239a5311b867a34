"""A cleaning pipeline over documents, from raw rows to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import language_id, near_duplicates, packing, repeated_windows, toxicity
from millrace.llm._common import fresh_path


BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session whose batches are small: JVM and worker hold each batch several times, and keep that memory for the stages to come.

    Its result is computed later, so the setting stays for the session; one that the user has made is not changed.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_SETTING, None) is None:
            spark.conf.set(_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_bounded
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not known."""
    return language_id.keep_identified(docs)


@_bounded
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one(docs)


@_bounded
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows that a document with a smaller id has."""
    return repeated_windows.keep_unrepeated(docs)


@_bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("language", identified), ("near duplicates", one_of_each), ("repeated windows", unrepeated), ("packing", packed)]

#: Trained models, near-duplicate classes and packings are beyond SQL; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
