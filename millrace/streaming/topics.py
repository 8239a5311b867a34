"""Topic routing, duplicates, retries and dead letters over streams of messages.

A message row has message_id, kind, payload, attempt and ts. All functions but the writers work on batch
and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "message_id string, kind string, payload string, headers map<string,string>, attempt int, ts timestamp"
MAX_ATTEMPTS = 3
DEFAULT_TOPIC = "platform-events"
# Topic of each kind of message. Kinds that are named after a product are the caller's to add.
TOPICS = {
    "train": "training-jobs",
    "training_progress": "training-events",
    "model_ready": "model-events",
    "inference": "inference-events",
    "pressure": "pipeline.pressure.events",
    "invalidation": "pipeline.artifact.invalidation",
    "splice": "pipeline.splice.events",
    "platform": "platform-events",
    "agi": "agi-decisions",
    "document_vectorize": "document.vectorize",
    "document_artifacts": "document.artifacts",
    "dead_letter": "pipeline.dead-letter",
}


def topic_of(kind: Column, topics: dict[str, str] | None = None) -> Column:
    """The topic of a kind, which is trimmed and lower-cased first; the default topic for others."""
    out = F.lit(DEFAULT_TOPIC)
    for name, topic in (TOPICS if topics is None else topics).items():
        out = F.when(F.lower(F.trim(kind)) == name, F.lit(topic)).otherwise(out)
    return out


def read_messages(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the JSON messages in a folder; the number of files bounds a batch."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_of_key(messages: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key's first message; a key is forgotten once the watermark is past it, so state is bounded."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(messages: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Messages of each kind in tumbling windows; late ones count until the watermark is past their window."""
    return messages.withWatermark(ts, delay).groupBy(F.window(ts, width), "kind").agg(F.count("*").alias("n"))


def settle(messages: DataFrame, ok: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Messages with outcome: ack, retry (with one more attempt) or dead_letter."""
    outcome = F.when(ok, "ack").when(F.col("attempt") >= most, "dead_letter").otherwise("retry")
    return messages.withColumn("outcome", outcome).withColumn("attempt", F.when(F.col("outcome") == "retry", F.col("attempt") + 1).otherwise(F.col("attempt")))


def publish(messages: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Start a query that appends each message to its topic's folder; retries and dead letters have topics of their own."""
    routed = messages.withColumn("topic", topic_of(F.col("kind")))

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("append").partitionBy("topic").parquet(folder)

    query = routed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query.trigger(processingTime="1 second")).start()
