import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import near_duplicates
from tests.llm import cases


def test_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        kept = out.cache()
        sizes.append((docs.count(), kept.count()))
        docs = kept
    assert all(0 < b <= a for a, b in sizes)
    assert sizes[3][0] == sizes[3][1]  # repeats are cut from texts, no row goes
    first = spark.read.parquet(f"{small}/documents.parquet")
    assert near_duplicates.keep_one(first).count() < first.count()


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024


def test_run_over_odd_tables(spark, tmp_path):
    """Nulls, empty texts, clashing names and tables without rows."""
    for name, docs in (("odd", cases.documents(spark)), ("empty", cases.empty(spark)), ("nulls", cases.nulls(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(rows) > 0) == (name == "odd")


def test_batches_of_texts_are_small(spark, small):
    """Every stage bounds the bytes that a Python worker gets at once; 600 texts of 60 KB were one batch of 36 MB."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("some words "), 5500).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["bytes"])

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4:2]:
        spark.conf.unset(setting)
        stage(spark, docs, small)
        assert max(r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()) < 2 * corpus_pipeline.BATCH_BYTES
    spark.conf.set(setting, "1000000")
    corpus_pipeline.unrepeated(spark, docs, small)
    assert spark.conf.get(setting) == "1000000"  # the user's own stays
    spark.conf.unset(setting)
