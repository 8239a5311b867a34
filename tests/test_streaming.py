import json

from pyspark.sql import functions as F

from millrace.streaming import claims, topics


def test_publish_routes_to_topics(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"message_id": str(i), "kind": k, "payload": "{}", "attempt": 1, "ts": "2024-01-01T00:00:00Z"} for i, k in enumerate(["train", "Dead_Letter ", "other"])]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    topics.publish(topics.read_messages(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.message_id, r.topic) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("0", "training-jobs"), ("1", "pipeline.dead-letter"), ("2", "platform-events")}


def test_settle(spark):
    rows = spark.createDataFrame([("a", 1, True), ("b", 1, False), ("c", 3, False)], "id string, attempt int, ok boolean")
    got = {r.id: (r.outcome, r.attempt) for r in topics.settle(rows, F.col("ok")).collect()}
    assert got == {"a": ("ack", 1), "b": ("retry", 2), "c": ("dead_letter", 3)}


CLAIM = "key string, message_id string, fingerprint string, ts timestamp"


def run_claims(spark, tmp_path, batches, **more):
    """Roles of messages that come in one file after another."""
    import datetime as dt

    src = tmp_path / "m"
    src.mkdir()
    name = f"claims_{tmp_path.name.replace('-', '_')}"
    q = None
    for batch in batches:
        rows = [(k, m, f, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for k, m, f, s in batch]
        spark.createDataFrame(rows, CLAIM).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(CLAIM).parquet(str(src))
        out = claims.claim_stream(stream, **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        q = out.outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return {(r.message_id, r.role, r.attempt) for r in spark.read.parquet(str(tmp_path / "out")).collect()}, q


def test_claims_on_a_stream(spark, tmp_path):
    got, _ = run_claims(spark, tmp_path, [[("k", "1", "f", 0), ("k", "2", "f", 1), ("k", "3", "g", 2), ("j", "4", "f", 3)]])
    assert got == {("1", "owner", 1), ("2", "duplicate", 1), ("3", "conflict", 1), ("4", "owner", 1)}


def test_claims_expire_and_are_forgotten(spark, tmp_path):
    batches = [[("k", "1", "f", 0)], [("k", "2", "f", 200), ("k", "3", "f", 301)], [("x", "9", "f", 10_000)], [("x", "10", "f", 10_001)], [("k", "4", "g", 10_002)]]
    got, q = run_claims(spark, tmp_path, batches, lease_s=300, keep_s=1000, delay="1 second")
    assert {("1", "owner", 1), ("2", "duplicate", 1), ("3", "owner", 2)} <= got
    assert ("4", "owner", 1) in got  # the key is forgotten: another fingerprint is no conflict


def test_watermarked_functions_build(spark, tmp_path):
    src = tmp_path / "w"
    src.mkdir()
    m = topics.read_messages(spark, str(src))
    assert topics.first_of_key(m, "message_id").isStreaming and topics.windowed_counts(m).isStreaming
