import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import language_id, toxicity
from tests.llm import cases


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.train(docs))
    got = out.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row.a > 0.98 and 0 <= row.lo and row.hi <= 1
    assert out.count() == docs.count()


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    en, de = (" ".join(docs.filter(f"lang = '{x}'").first().text.split()[:40]) for x in ("en", "de"))
    mixed = cases.documents(spark, [(1, en + " " + de)])
    spans = language_id.identify(mixed, model, spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and spans[0].start == 0


def test_language_odd_cases(spark):
    docs = cases.documents(spark)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert len(got) == 14 and got[4].lang_pred == got[5].lang_pred == got[9].lang_pred == "und" and got[9].score == 0
    assert language_id.identify(cases.empty(spark), language_id.train(cases.empty(spark))).count() == 0
    assert {r.lang_pred for r in language_id.identify(cases.nulls(spark), language_id.train(cases.nulls(spark))).collect()} == {"und"}
    assert language_id.keep_identified(docs).columns == docs.columns


def made_up(spark, n=900):
    rnd = random.Random(7)
    plain = ["river", "stone", "window", "garden", "letter", "winter", "market", "silver"]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) + rnd.choice("abcdefg") for _ in range(40)]
        bad = rnd.random() < 0.3
        if bad:
            w[rnd.randrange(40)] = "grumble" + rnd.choice(["ish", "ed", "r", ""])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return cases.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = made_up(spark)
    out = toxicity.score(docs, toxicity.train(docs, labels, epochs=3)).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 900 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_toxicity_odd_cases(spark):
    docs, labels, _ = made_up(spark, 300)
    model = toxicity.train(docs, labels, epochs=1)
    odd = cases.documents(spark)
    assert toxicity.score(odd, model).count() == odd.count()
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    none = labels.filter("false")
    assert toxicity.train(docs, none) is None and toxicity.train(cases.empty(spark), labels) is None
    assert toxicity.score(cases.empty(spark), model).count() == 0
    assert toxicity.keep_clean(odd, none).count() == odd.count()


def test_toxicity_thresholds_count_all_rows_where_the_sample_is_capped(spark):
    """A word of all toxic and a quarter of the clean texts: evidence at 1:1, but most often wrong at the true 1:8."""
    rnd = random.Random(3)
    plain = ["river", "stone", "window", "garden", "letter", "winter", "market", "silver"]
    rows, labels = [], []
    for i in range(1800):
        bad = i % 9 == 0
        w = [rnd.choice(plain) for _ in range(30)]
        if bad or rnd.random() < 0.25:
            w[rnd.randrange(30)] = "grumble"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, truth = cases.documents(spark, rows), dict(labels)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels, per_class=150, epochs=3)).collect()
    assert sum(r.predicted != truth[r.doc_id] for r in out) <= 1.1 * sum(truth.values())


def test_more_languages_than_a_byte_holds(spark):
    rnd = random.Random(9)
    words = {k: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(5)] for k in range(150)}
    rows = [(1000 * k + i, " ".join(rnd.choice(words[k]) for _ in range(30))) for k in range(150) for i in range(6)]
    docs = cases.documents(spark, rows).withColumn("lang", F.format_string("l%03d", F.floor(F.col("doc_id") / 1000)))
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 1000:03d}" for r in got) > 0.99 * len(got) and len({r.lang_pred for r in got}) == 150


def test_unlearned_languages_scripts_and_junk_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rnd = random.Random(2)
    odd = [
        "Bardzo dziękuję za wiadomość, proszę przyjechać jutro rano do naszego domu nad jeziorem i zabrać ze sobą książki.",
        "Это русский текст о погоде и природе, который никто не учил, и потому он должен уйти.",
        "これは日本語の文章です。今日は天気がいいので、公園で本を読みます。",
        " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(30)),
    ]
    columns = docs.columns
    planted = docs.limit(4).withColumn("n", F.row_number().over(Window.orderBy("doc_id")))
    texts = spark.createDataFrame([(i + 1, t) for i, t in enumerate(odd)], "n int, text string")
    planted = planted.drop("text").join(texts, "n").withColumn("doc_id", F.col("n").cast("long") + 10**9).select(*columns)
    kept = language_id.keep_identified(docs.unionByName(planted))
    row = kept.agg(F.sum((F.col("doc_id") >= 10**9).cast("int")).alias("odd"), F.count("*").alias("n")).first()
    named = docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert not row.odd and row.n > 0.998 * named


def test_toxicity_sample_is_bounded_by_rows_and_bytes(spark):
    docs, labels, _ = made_up(spark, 400)
    hot = docs.filter("doc_id = 7").limit(1).crossJoin(spark.range(3000)).drop("id")  # one id, the same text
    other = cases.documents(spark, [(8, f"other {i} " * 20) for i in range(2000)] + [(9, "w " * 700_000)])  # one id, many texts; a text too long to fit on
    every = docs.unionByName(hot).unionByName(other)
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = toxicity._sample(every, toxic, 200, 1 << 20).collect()
    assert len(rows) == len({(r.doc_id, r.hash) for r in rows}) and len(rows) < 600
    few = toxicity._sample(every, toxic, 10**6, 20_000).collect()
    assert len(few) < 300
    assert toxicity.score(every, toxicity.train(every, labels, per_class=200, epochs=1)).count() == every.count()
