"""Documents: validation, identity, claims, chunk contents, vectors, artifacts and the outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEASE_S, MAX_ATTEMPTS, OUTBOX_LIMIT = 60, 3, 100
# Error codes after which an operation is tried again.
RETRYABLE = ("STORAGE_UNAVAILABLE", "VECTORIZER_ERROR", "VECTORIZER_TIMEOUT", "CANCELLED")
# States that end an operation.
TERMINAL = ("succeeded", "terminal_failure", "dead_lettered")


def first_error(rules: Sequence[tuple[Column, str]]) -> Column:
    """The message of the first rule that is broken; null if none is. Rules say what is wrong."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(message)) for bad, message in rules])


def score_rules(score: Column) -> list[tuple[Column, str]]:
    """A quality score is finite and from 0 to 1."""
    return [(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "qualityScore must be finite"), ((score < 0) | (score > 1), "qualityScore must be between 0 and 1")]


def chunk_rules(chunks: Column) -> list[tuple[Column, str]]:
    """Chunks (chunkId, index, text, storage) have unique ids, the index of their place, and text or storage."""
    ids = F.transform(chunks, lambda c: c["chunkId"])
    return [
        (F.size(chunks) == 0, "chunks must not be empty"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "chunk ids must be unique"),
        (F.exists(F.transform(chunks, lambda c, i: c["index"] != i), lambda x: x), "chunk index must equal its position"),
        (F.exists(chunks, lambda c: c["text"].isNull() & c["storage"].isNull()), "chunk needs text or storage"),
    ]


def storage_key(uri: Column, provider: Column, bucket: Column, key: Column) -> Column:
    """The uri, else provider://bucket/key, else the key."""
    full = F.when(provider.isNotNull() & bucket.isNotNull() & key.isNotNull(), F.concat(provider, F.lit("://"), bucket, F.lit("/"), key))
    return F.coalesce(uri, full, key)


def idempotency_key(*identity: Column) -> Column:
    """SHA-256 over the identity fields in order, nulls told from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in identity]
    return F.sha2(F.concat_ws("|", *parts), 256)


def operation_id(key: Column) -> Column:
    return F.concat(F.lit("docop_"), F.substring(key, 1, 24))


def claim(arrivals: DataFrame, key: str, fingerprint: str, order: str) -> DataFrame:
    """Each arrival's role: owner (the first of its key), duplicate (same fingerprint), or conflict."""
    first = arrivals.groupBy(key).agg(F.min(F.struct(order, fingerprint)).alias("__first"))
    out = arrivals.join(first, key)
    role = F.when(F.col(order) == F.col(f"__first.{order}"), "owner").when(F.col(fingerprint) == F.col(f"__first.{fingerprint}"), "duplicate").otherwise("conflict")
    return out.withColumn("role", role).withColumn("owner", F.col(f"__first.{order}")).drop("__first")


def conflict_id(key: Column, fingerprint: Column) -> Column:
    return F.concat_ws(":", key, F.lit("conflict"), F.substring(fingerprint, 1, 24))


def resolve_chunks(chunks: DataFrame, storage: DataFrame, ref: str, text: str, content: str) -> DataFrame:
    """content of each chunk (inline text first, else the stored one) and an error code where there is none.

    storage has `ref` and binary `content`.
    """
    stored = storage.select(F.col(ref).alias("__ref"), F.col(content).alias("__content"))
    out = chunks.join(stored, chunks[ref] == F.col("__ref"), "left")
    decoded = F.when(F.is_valid_utf8(F.col("__content").cast("string")), F.decode(F.col("__content"), "UTF-8"))
    error = F.when(F.col(text).isNotNull(), None).when(F.col(ref).isNull(), "INVALID_STORAGE_REFERENCE").when(F.col("__ref").isNull(), "STORAGE_CONTENT_NOT_FOUND").when(decoded.isNull(), "INVALID_STORAGE_CONTENT")
    return out.withColumn("content", F.coalesce(F.col(text), decoded)).withColumn("error_code", error).drop("__ref", "__content")


def vector_errors(vector: Column, dimensions: int | None) -> Column:
    """What is wrong with a vector; null if nothing is."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rules = [(vector.isNull() | (F.size(vector) == 0), "vector must not be empty"), (odd, "vector must be finite")]
    return first_error(rules + ([(F.size(vector) != dimensions, "dimensions differ")] if dimensions else []))


def vectorize(chunks: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str = "content") -> DataFrame:
    """chunks with `vector`, by a function over batches of texts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield fn(batch)

    return chunks.withColumn("vector", run(F.col(text)))


def artifacts(requested: Column) -> Column:
    """Each requested artifact's status: an embedding is fulfilled, others are unsupported and not required."""
    return F.transform(requested, lambda a: F.struct(a["artifactType"].alias("artifactType"), F.when(a["artifactType"] == "embedding", "fulfilled").otherwise("unsupported").alias("status")))


def finish(operations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Operations after their outcomes (operation_id, token, ok, error_code, at): only a matching token on a processing one counts.

    Success and non-retryable errors end the operation and set its outbox to PENDING; retryable ones free the lease.
    """
    joined = operations.join(outcomes.withColumnRenamed("token", "__token"), "operation_id", "left")
    valid = F.coalesce((F.col("status") == "processing") & (F.col("token") == F.col("__token")), F.lit(False))
    again = F.col("error_code").isin(*RETRYABLE)
    status = F.when(~valid, F.col("status")).when(F.col("ok"), "succeeded").when(again & (F.col("attempt") < MAX_ATTEMPTS), "retryable_failure").when(again, "dead_lettered").otherwise("terminal_failure")
    out = joined.withColumn("new_status", status).withColumn("stale", F.col("__token").isNotNull() & ~valid)
    topic = F.when(F.col("new_status") == "succeeded", "document.artifacts").otherwise("pipeline.dead-letter")
    ended = valid & F.col("new_status").isin(*TERMINAL)
    out = out.withColumn("outbox", F.when(ended, "PENDING").otherwise(F.col("outbox"))).withColumn("outbox_topic", F.when(ended, topic).otherwise(F.col("outbox_topic")))
    out = out.withColumn("lease_until", F.when(valid, None).otherwise(F.col("lease_until"))).withColumn("updated_at", F.when(valid, F.col("at")).otherwise(F.col("updated_at")))
    return out.withColumn("status", F.col("new_status")).select(*operations.columns, "stale")


def pending_outbox(operations: DataFrame, limit: int = OUTBOX_LIMIT) -> DataFrame:
    """The oldest operations that wait for publication."""
    return operations.filter(F.col("outbox") == "PENDING").orderBy("updated_at", "operation_id").limit(limit)


def message_action(status: Column, attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    """What a consumer does: ack when done, retry or dead-letter a retryable failure."""
    return F.when(status == "succeeded", "publish_ack").when((status == "retryable_failure") & (attempts < most), "retry").otherwise("dead_letter")


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The current view of an append-only log: each key's last row."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("__r")).select(key, "__r.*")


def lease_expired(now: Column) -> Column:
    return F.col("lease_until") <= now


def reclaim(operations: DataFrame, now: Column, lease_s: int = LEASE_S) -> DataFrame:
    """Operations whose lease ran out, or that failed retryably, claimed anew: one more attempt and a new token."""
    free = ((F.col("status") == "processing") & lease_expired(now)) | (F.col("status") == "retryable_failure")
    token = F.sha2(F.concat_ws(":", "operation_id", (F.col("attempt") + 1).cast("string")), 256)
    out = operations.filter(free).withColumn("token", token).withColumn("attempt", F.col("attempt") + 1)
    return out.withColumn("status", F.lit("processing")).withColumn("lease_until", now + F.make_dt_interval(secs=F.lit(lease_s)))


def newest_per(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("__n = 1").drop("__n")


# Message headers that are kept with an operation.
KEPT_HEADERS = ("correlationId", "correlation_id", "requestId", "request_id", "traceId", "trace_id", "causationId", "causation_id", "operationId", "operation_id")


def kept_headers(headers: Column, message_id: Column) -> Column:
    """The headers that go on, and the message's id."""
    kept = F.map_filter(headers, lambda k, _: k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(kept, lambda k, _: k != "messageId"), F.create_map(F.lit("messageId"), message_id))


def agreed(root: Column, nested: Column) -> Column:
    """A field that may stand at the root and nested: the root's value first; an error where both differ."""
    differ = root.isNotNull() & nested.isNotNull() & (root != nested)
    return F.struct(F.coalesce(root, nested).alias("value"), F.when(differ, "root and nested values differ").alias("error"))


def result_message(operation_id: Column, status: Column, error_code: Column) -> Column:
    """The outbound payload of an operation that has ended."""
    kind = F.when(status == "succeeded", "document.vectorized").otherwise("document.failed")
    return F.struct(kind.alias("type"), operation_id.alias("operationId"), status.alias("status"), error_code.alias("errorCode"))


def result_errors(chunk_ids: Column, result_ids: Column, vectors: Column, dimensions: int | None = None) -> Column:
    """What is wrong with a vectorizer's answer as a whole: count, ids by position, then the first vector that is wrong; null if nothing is."""
    size = F.size(chunk_ids)
    swapped = F.exists(F.arrays_zip(chunk_ids.alias("a"), result_ids.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
    uneven = F.size(F.array_distinct(F.transform(vectors, lambda v: F.size(v)))) > 1
    first = F.get(F.filter(F.transform(vectors, lambda v: vector_errors(v, dimensions)), lambda e: e.isNotNull()), F.lit(0))
    wrong_count = (F.size(result_ids) != size) | (F.size(vectors) != size)
    return F.when(wrong_count, "result count differs").when(swapped, "chunk ids differ").when(first.isNotNull(), first).when(uneven, "dimensions differ")


def mark_published(operations: DataFrame, published: DataFrame) -> DataFrame:
    """The operations with outbox PUBLISHED where they were pending and their id is in `published` (operation_id)."""
    sent = published.select("operation_id", F.lit(True).alias("__sent")).dropDuplicates(["operation_id"])
    out = operations.join(sent, "operation_id", "left")
    return out.withColumn("outbox", F.when(F.col("__sent") & (F.col("outbox") == "PENDING"), "PUBLISHED").otherwise(F.col("outbox"))).select(*operations.columns)
