"""Toxicity scores by a small convolutional text classifier, trained in numpy.

Words and their prefixes are hashed into an embedding table and the vectors of a word are added, so
that inflected and compound forms share what their stem has learned; filters of several widths run over the word vectors, each filter's maximum over the whole text feeds a logistic output.
Only fitting uses a sample. Thresholds are calibrated by the language that the text seems to have (bag of
hashed words) on counts over all labelled rows, and scores are shifted so that 0.5 is that language's threshold.

Null and empty texts get the score of an empty text. Rows with a null id are scored and never learned
from. Repeated ids: every row is scored, and different texts of one id are fitted on by the one label. Without any labelled row of both classes the score is 0.
Other columns of the input are ignored by `score`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import fold, held_out, unit_hash
from millrace.llm._text import Words, groups

BUCKETS = 1 << 17
SAMPLE_BYTES = 8 << 20  # of texts of a class that are fitted on, at most
LONGEST = 64 << 10  # bytes of a text that may be fitted on; longer ones still count for thresholds
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7, 8)
#: Calibration counts logits in bins of 1 / FINE, up to FAR from 0.
FINE, FAR = 64, 30


def _buckets(words: Words) -> np.ndarray:
    """The buckets of each word and its prefixes; 0 stands for nothing."""
    h = words.hashes(PREFIXES)
    return np.where(h > 0, np.maximum(h & np.uint64(BUCKETS - 1), 1), 0).astype(np.int32)


def _ids(words: Words, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word, with `gap` empty words before each text; and where each text starts."""
    first = words.first_of_doc()
    ids = np.zeros((len(words.start) + gap * (words.n + 1), 1 + len(PREFIXES)), np.int32)
    ids[np.arange(len(words.start)) + gap * (words.doc + 1)] = _buckets(words)
    return ids, first[:-1] + gap * np.arange(words.n)


class TextCNN:
    """The classifier; every array is a fixed size."""

    def __init__(self, dim: int = 16, filters: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.gap = max(WIDTHS)
        self.emb = (rng.standard_normal((BUCKETS, dim)) * 0.02).astype(np.float32)
        self.emb[0] = 0
        self.known = np.ones(BUCKETS, bool)
        self.conv = [(rng.standard_normal((w * dim, filters)) / np.sqrt(w * dim)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(filters * len(WIDTHS), np.float32)
        self.out = (rng.standard_normal(filters * len(WIDTHS)) * 0.1).astype(np.float32)
        self.out_bias = np.float32(0)
        self.langs: list[str] = []
        self.lang_table = np.zeros((BUCKETS, 1), np.float32)
        self.threshold = np.zeros(1, np.float32)

    def warm_start(self, ids: list[np.ndarray], labels: np.ndarray, use: np.ndarray, least_texts: int) -> None:
        """Give the first dimension of each bucket the evidence that it speaks for the class, in standard deviations.

        A bucket without evidence has the sample's own class share, whatever the share in all rows. Buckets of fewer than least_texts texts keep a zero vector.
        """
        seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for i in np.flatnonzero(use):
            own = np.unique(ids[i])
            seen[own] += 1
            toxic[own] += labels[i]
        share = labels[use].mean()
        z = (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        self.known = seen >= least_texts
        self.known[0] = False
        self.emb[:, 0] = np.clip((z - 4) / 4, 0, 3)
        self.emb[~self.known] = 0
        for k, w in zip(self.conv, WIDTHS, strict=True):
            k[:: len(k) // w, 0] = 1.0

    def forward(self, ids: np.ndarray, starts: np.ndarray, where: bool = False):
        """Max-pooled activations of each text and, on demand, the positions of the maxima."""
        e = self.emb[ids[:, 0]]
        for c in range(1, ids.shape[1]):
            e += self.emb[ids[:, c]]
        dim = e.shape[1]
        n = len(ids) - self.gap + 1
        z = []
        for w, k in zip(WIDTHS, self.conv, strict=True):
            total = e[:n] @ k[:dim]
            for j in range(1, w):
                total += e[j : j + n] @ k[j * dim : (j + 1) * dim]
            z.append(total)
        z = np.concatenate(z, 1)
        top = np.maximum.reduceat(z, starts, axis=0)
        pooled = np.maximum(top + self.bias, 0)
        if not where:
            return pooled
        text = np.zeros(n, np.int64)
        text[starts[1:]] = 1
        text = np.cumsum(text)
        at = np.zeros(top.shape, np.int64)
        for f in range(z.shape[1]):
            hit = np.flatnonzero(z[:, f] == top[text, f])
            at[text[hit][::-1], f] = hit[::-1]  # the first maximum wins
        return pooled, at

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias

    def language(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.lang_table[ids[:, 0]], starts, axis=0).argmax(1)

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's logit and the index of the language that it seems to have."""
        logits, seems = np.zeros(len(texts), np.float32), np.zeros(len(texts), np.int64)
        for lo, hi in groups(texts):
            ids, starts = _ids(Words(texts[lo:hi]), self.gap)
            logits[lo:hi] = self.logits(self.forward(ids, starts))
            seems[lo:hi] = self.language(ids, starts)
        return logits, seems

    def score(self, texts: list[str | None]) -> np.ndarray:
        logits, seems = self.judge(texts)
        raw = (logits - self.threshold[seems]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name, value, grad, rows=slice(None), scale=1.0):
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        value[rows] -= scale * self.rate * (m[rows] / (1 - 0.9**self.t)) / (np.sqrt(v[rows] / (1 - 0.99**self.t)) + 1e-6)


def fit(model: TextCNN, ids: list[np.ndarray], labels: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01) -> None:
    """Minimise the logistic loss with Adam; ids: the words' buckets of each text."""
    rng = np.random.default_rng(11)
    adam, gap, dim, per = _Adam(rate), model.gap, model.emb.shape[1], model.conv[0].shape[1]
    pad = np.zeros((gap, 1 + len(PREFIXES)), np.int32)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            flat = np.concatenate([x for i in some for x in (pad, ids[i])] + [pad])
            sizes = np.array([len(ids[i]) + gap for i in some])
            starts = np.cumsum(sizes) - sizes
            pooled, at = model.forward(flat, starts, where=True)
            p = 1 / (1 + np.exp(-model.logits(pooled)))
            d = ((p - labels[some]) / len(some)).astype(np.float32)
            d_pool = d[:, None] * model.out * (pooled > 0)
            adam.t += 1
            d_emb: dict = {}
            rows, grads = [], []
            for k, w in enumerate(WIDTHS):
                part = slice(k * per, (k + 1) * per)
                g_conv = np.zeros_like(model.conv[k])
                for j in range(w):
                    pos = at[:, part] + j
                    e = model.emb[flat[pos]].sum(2)  # text, filter, dim
                    g = d_pool[:, part]
                    g_conv[j * dim : (j + 1) * dim] = np.einsum("tfd,tf->df", e, g)
                    g_e = g[:, :, None] * model.conv[k][j * dim : (j + 1) * dim].T[None]
                    for c in range(flat.shape[1]):
                        rows.append(flat[pos, c].ravel())
                        grads.append(g_e.reshape(-1, dim))
                d_emb[k] = g_conv
            adam.step("out", model.out, pooled.T @ d + 1e-4 * model.out)
            model.out_bias -= np.float32(adam.rate * d.sum())
            adam.step("bias", model.bias, d_pool.sum(0))
            for k in d_emb:
                adam.step(k, model.conv[k], d_emb[k])
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            used, back = np.unique(rows, return_inverse=True)
            summed = np.zeros((len(used), dim), np.float32)
            np.add.at(summed, back, grads)
            keep = model.known[used]
            adam.step("emb", model.emb, summed[keep], used[keep], 0.2)


def _calibrate(counts: pd.DataFrame, n_langs: int, least: int = 40) -> np.ndarray:
    """Per language the threshold of the fewest errors over all labelled rows.

    counts: n rows of each seems, bin, toxic and learned. Logits of rows that the model has learned from say
    nothing of others: the rest of a class stands for all of it, weighted by the inverse of its share.
    """
    whole = counts.groupby("toxic")["n"].sum()
    rest = counts[~counts["learned"]]
    if rest["toxic"].nunique() < 2:
        rest = counts
    weight = whole / rest.groupby("toxic")["n"].sum()
    rest = rest.assign(w=rest["n"] * rest["toxic"].map(weight))

    def best(own: pd.DataFrame) -> float:
        lo = int(own["bin"].min())
        size = int(own["bin"].max()) - lo + 1
        clean, toxic = (np.bincount(part["bin"] - lo, part["w"], size) for part in (own[own["toxic"] == 0], own[own["toxic"] == 1]))
        wrong = np.r_[0, np.cumsum(toxic)] + np.r_[np.cumsum(clean[::-1])[::-1], 0]  # errors if the first i bins are clean
        # of several, the one that calls the fewest texts toxic; it lies in the middle between the logits next to it
        last = first = int(np.flatnonzero(np.isclose(wrong, wrong.min(), rtol=0, atol=1e-6))[-1])
        while first and not clean[first - 1] and not toxic[first - 1]:
            first -= 1
        return (lo + (first + last + 1) // 2) / FINE

    out = np.full(n_langs, best(rest) if rest["toxic"].nunique() == 2 else 0.0, np.float32)
    for k, own in rest.groupby("seems"):
        if own["n"].sum() >= least and own["toxic"].nunique() == 2:
            out[k] = best(own)
    return out


def _sample(docs: DataFrame, toxic: DataFrame, per_class: int, class_bytes: int) -> DataFrame:
    """doc_id, hash and toxic of the texts to fit on: about per_class of each class and class_bytes of their bytes at most.

    Texts are drawn, not ids: all copies of a text with one id are one, so a repeated id does not swell the sample. Only ids, hashes
    and lengths are joined to the labels; each class's counts come to the driver.
    """
    texts = docs.filter(F.col("text").isNotNull() & (fold() != 0)).select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    texts = texts.filter(F.col("bytes") <= LONGEST).distinct().join(toxic, "doc_id")
    rate = F.lit(0.0)
    for row in texts.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect():
        share = min(1.0, per_class / row["n"], class_bytes / max(1, row["bytes"]))
        rate = F.when(F.col("toxic") == row["toxic"], F.lit(share)).otherwise(rate)
    return texts.filter(unit_hash("doc_id", "hash") < rate).select("doc_id", "hash", "toxic")


def _counts(docs: DataFrame, toxic: DataFrame, model: TextCNN, learned: pd.DataFrame) -> pd.DataFrame:
    """Rows with a label that are not held out, by seeming language, bin of the logit, class and whether the model learned from them.

    Every such row counts. Texts are not shuffled: documents are judged where they are, and only their ids
    and bins meet the labels. The driver gets one row for each of a bounded number of bins.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits, seems = shared.value.judge(batch["text"].to_pylist())
            bins = np.floor(np.clip(logits, -FAR, FAR) * FINE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], pa.array(seems.astype(np.int32)), pa.array(bins)], names=["doc_id", "hash", "seems", "bin"])

    texts = docs.filter(F.col("text").isNotNull() & (fold() != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    judged = texts.mapInArrow(judge, "doc_id long, hash long, seems int, bin int").join(toxic, "doc_id")
    known = spark.createDataFrame([(int(i), int(h), True) for i, h in zip(learned["doc_id"], learned["hash"], strict=True)], "doc_id long, hash long, learned boolean")
    judged = judged.join(F.broadcast(known), ["doc_id", "hash"], "left")  # of the bounded sample
    flag = F.coalesce("learned", F.lit(False)).alias("learned")
    counts = judged.groupBy("seems", "bin", "toxic", flag).agg(F.count("*").alias("n")).toPandas()
    shared.destroy()
    return counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, epochs: int = 6, least_texts: int = 4, class_bytes: int = SAMPLE_BYTES) -> TextCNN | None:
    """Fit on about per_class labelled texts of each class at most, of about class_bytes together, without a fifth of them; calibrate on all.

    Buckets seen in fewer than least_texts of the texts keep a zero vector, so that rare words are not learned by heart.
    Documents of fold 0, null ids, texts or labels take no part, texts over LONGEST bytes none in fitting. Tasks hash the words; the
    driver gets bucket numbers of that bounded sample only.
    """
    toxic = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = _sample(docs, toxic, per_class, class_bytes)
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text", "lang")
    sample = texts.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])  # of a bounded sample

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in groups(texts):
                words = Words(texts[lo:hi])
                rows, first = _buckets(words).astype("<i4"), words.first_of_doc()
                packed = [zlib.compress(rows[i:j].tobytes(), 1) for i, j in zip(first[:-1], first[1:], strict=True)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("doc_id", "hash", "lang")), part["toxic"].cast(pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "hash", "lang", "toxic", "ids"])

    rows = sample.select("doc_id", "hash", "lang", "toxic", "text").mapInArrow(hashed, "doc_id long, hash long, lang string, toxic int, ids binary").toPandas()
    if rows["toxic"].nunique() < 2:
        return None
    rows = rows.sort_values(["doc_id", "ids"], kind="stable").reset_index(drop=True)
    ids = [np.frombuffer(zlib.decompress(x), "<i4").reshape(-1, 1 + len(PREFIXES)) for x in rows.pop("ids")]
    y = rows["toxic"].to_numpy(np.float32)
    check = np.random.default_rng(3).random(len(rows)) < 0.2
    model = TextCNN()
    model.warm_start(ids, y, ~check, least_texts)
    langs = sorted(rows["lang"].dropna().unique()) or [""]
    counts = np.full((BUCKETS, len(langs)), 0.2)
    for k, lang in enumerate(langs):
        own = [ids[i][:, 0] for i in np.flatnonzero((rows["lang"] == lang) & ~check)]
        if own:
            counts[:, k] += np.bincount(np.concatenate(own), minlength=BUCKETS)
    model.langs, model.lang_table = langs, np.log(counts / counts.sum(0)).astype(np.float32)
    model.lang_table[0] = 0
    learn = np.flatnonzero(~check)
    if len(np.unique(y[learn])) == 2:
        fit(model, [ids[i] for i in learn], y[learn], epochs)
    del ids
    model.threshold = _calibrate(_counts(docs, toxic, model, rows.iloc[learn]), len(langs))
    return model


def score_column(model: TextCNN | None, text: Column, spark) -> Column:
    """The score of each whole text, 0 to 1."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            yield pd.Series(m.score(batch.tolist()))

    return score(text)


def score(docs: DataFrame, model: TextCNN | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = docs.select("doc_id", held_out().alias("held_out"), score_column(model, F.col("text"), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that are not predicted to be toxic."""
    return docs.filter(score_column(train(docs, labels), F.col("text"), docs.sparkSession) < 0.5)
