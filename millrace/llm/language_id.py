"""Language identification of mixed-language text.

Script ranges (by the lead bytes of UTF-8) narrow the candidate languages of each word; character
trigrams score each word for the candidates; Viterbi with a switching penalty labels the words of a
text, and runs of equal labels are its spans.

Nulls, texts without a letter: language `und`, score 0, no spans. Rows with a null id are labelled
like others but never learned from. Repeated rows and ties: the smaller language name wins a tie.
An empty table, or one without a learnable row, gives `und` for every row. Other columns of the
input are ignored by `identify`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import bounded_sample, fold, held_out
from millrace.llm._text import WORD_BYTE, Words, groups

UNDETERMINED = "und"
TRIGRAM_BITS = 16

# Script by lead byte of UTF-8. ASCII and Latin blocks 0, then one number per range.
SCRIPT_RANGES = (
    (0xC3, 0xCA, 0),  # Latin
    (0xCD, 0xCF, 1),  # Greek
    (0xD0, 0xD4, 2),  # Cyrillic
    (0xD5, 0xD5, 3),  # Armenian
    (0xD6, 0xD7, 4),  # Hebrew
    (0xD8, 0xDF, 5),  # Arabic and neighbours
    (0xE0, 0xE1, 6),  # Indic, Thai, Georgian, Ethiopic, Khmer and others
    (0xE3, 0xED, 7),  # Kana, Han, Hangul
)
SCRIPTS = 8
_SCRIPT = np.zeros(256, np.int8)
for _first, _last, _script in SCRIPT_RANGES:
    _SCRIPT[_first : _last + 1] = _script


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each byte of each word, and where each word's buckets start."""
    length = words.stop - words.start
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(words.start - begin, length)
    b = np.where(WORD_BYTE[words.buf], words.buf, 32).astype(np.uint32)
    code = (b[at - 1] << np.uint32(16)) | (b[at] << np.uint32(8)) | b[at + 1]
    code = code * np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - TRIGRAM_BITS), begin


def _scripts(words: Words, begin: np.ndarray) -> np.ndarray:
    length = words.stop - words.start
    at = np.arange(int(length.sum())) + np.repeat(words.start - begin, length)
    return np.maximum.reduceat(_SCRIPT[words.buf[at]], begin) if len(begin) else np.zeros(0, np.int8)


def _numbered(words: Words) -> np.ndarray:
    """Whether each word has a digit."""
    digits = np.r_[0, np.cumsum((words.buf >= 48) & (words.buf <= 57))]
    return digits[words.stop] > digits[words.start]


class LanguageModel:
    """Log probabilities of trigram buckets by language, and the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, penalty: float):
        self.langs, self.penalty = langs, penalty
        smooth = counts.astype(np.float64) + 0.5
        share = smooth / smooth.sum(0)
        self.table = np.log(share).astype(np.float32)
        #: what a trigram of a language scores on average, had it not been counted itself
        self.expected = (share * np.log((np.maximum(counts - 1, 0) + 0.5) / smooth.sum(0))).sum(0)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.barred = (share < 0.001) & (share >= 0.001).any(1, keepdims=True)

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word and language the log probability of its trigrams, and a score, 0 for the best; barred languages get a low one."""
        code, begin = _trigrams(words)
        if not len(begin):
            return np.zeros((0, len(self.langs)), np.float32), np.zeros((0, len(self.langs)), np.float32)
        raw = np.add.reduceat(self.table[code], begin, axis=0)
        s = raw - 50 * self.barred[_scripts(words, begin)]
        return raw, np.maximum(s - s.max(1, keepdims=True), -12).astype(np.float32)

    def label(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best path's language of each word. All texts advance together, the longest first."""
        n, k = scores.shape
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        starts, lengths = first[:-1][order], counts[order]
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        # back[w, l]: the label before, if word w has label l; only "same" or "best" occur
        kind = np.min_scalar_type(-max(k, 1))
        best_before = np.zeros(n, kind)
        switched = np.zeros((n, k), bool)
        v = np.zeros((len(order), k), np.float32)
        last = np.zeros(len(order), kind)
        for t, m in enumerate(alive.tolist()):
            at = starts[:m] + t
            if t:
                v = v[:m]
                top = v.argmax(1)
                reach = v[np.arange(m), top][:, None] - self.penalty
                best_before[at] = top
                switched[at] = reach > v
                v = np.maximum(v, reach)
            v = v[:m] + scores[at]
            if m < len(v) or t + 1 >= len(alive) or alive[t + 1] < m:
                done = alive[t + 1] if t + 1 < len(alive) else 0
                last[order[done:m]] = v[done:m].argmax(1)
        out = np.zeros(n, kind)
        now = last[order]
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            at = starts[:m] + t
            out[at] = now[:m]
            if t:
                now[:m] = np.where(switched[at, now[:m]], best_before[at], now[:m])
        return out

    def predict(self, texts: list[str | None]) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of texts: their range, words, labels of the words, how far the words' trigrams are above what the label's have on average (0 for words with digits), and first words."""
        for lo, hi in groups(texts):
            words = Words(texts[lo:hi])
            first = words.first_of_doc()
            raw, scores = self.word_scores(words)
            labels = self.label(scores, first).astype(np.int64)
            above = raw[np.arange(len(labels)), labels] - (words.stop - words.start) * self.expected[labels]
            yield lo, hi, words, labels, np.where(_numbered(words), 0, above), first


def train(docs: DataFrame, per_language: int = 3000, penalty: float = 6.0) -> LanguageModel | None:
    """Fit on about per_language documents of each language (all where there are fewer).

    Documents of fold 0, with a null id, text or lang take no part. Counts of trigram buckets are
    summed by Spark; what comes to the driver is bounded by 2 ** TRIGRAM_BITS for each language.
    """
    learn = docs.select("doc_id", "text", "lang").filter((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(learn, "lang", per_language).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                sums = total.setdefault(lang, np.zeros((1 << TRIGRAM_BITS) + SCRIPTS, np.int64))
                texts = part["text"].tolist()
                for lo, hi in groups(texts):
                    words = Words(texts[lo:hi])
                    code, begin = _trigrams(words)
                    sums += np.bincount(code, minlength=len(sums))
                    sums += np.bincount(_scripts(words, begin).astype(np.int64) + (1 << TRIGRAM_BITS), minlength=len(sums))
        for lang, sums in total.items():
            some = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bucket": some.astype(np.int32), "n": sums[some]})

    rows = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return None
    langs = sorted(rows["lang"].unique())
    counts = np.zeros(((1 << TRIGRAM_BITS) + SCRIPTS, len(langs)))
    counts[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(langs)})] = rows["n"]
    return LanguageModel(langs, counts[: 1 << TRIGRAM_BITS], counts[1 << TRIGRAM_BITS :], penalty)


def language_column(model: LanguageModel | None, text, spark, spans: bool = False):
    """A column with lang_pred, score (the share of the text's letters that have this language), evidence and spans.

    Evidence is how far a trigram of the text, on average, is above (or below: negative) what its word's language has, in natural
    logarithms. Words with digits, such as numbers and keys, are in no language and count as average.
    """
    kind = "lang_pred string, score double, evidence double" + ", spans array<struct<start:int,stop:int,lang:string>>" * spans
    if model is None:
        nothing = [F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("evidence")]
        return F.struct(*nothing, *[F.array().cast("array<struct<start:int,stop:int,lang:string>>").alias("spans")] * spans)
    shared = spark.sparkContext.broadcast(model)  # bounded by languages x buckets

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            yield _labelled(m, batch.tolist(), spans)

    return F.when(text.rlike(r"\p{L}"), label(text)).otherwise(F.lit(None))


def _labelled(m: LanguageModel, texts: list[str | None], spans: bool) -> pd.DataFrame:
    k = len(m.langs)
    pred, score, evidence = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    found: list[list[dict]] = [[] for _ in texts]
    for lo, hi, words, labels, above, first in m.predict(texts):
        weight = np.bincount(words.doc * k + labels, words.stop - words.start, (hi - lo) * k).reshape(-1, k)
        total = weight.sum(1)
        some = total > 0
        pred[lo:hi] = np.where(some, weight.argmax(1), -1)
        score[lo:hi] = np.where(some, weight.max(1) / np.maximum(total, 1), 0)
        evidence[lo:hi] = np.bincount(words.doc, above, hi - lo) / np.maximum(total, 1)
        if spans:
            for i in range(hi - lo):
                own = labels[first[i] : first[i + 1]]
                if len(own):
                    cut = np.flatnonzero(np.diff(own)) + 1
                    for a, b in zip(np.r_[0, cut], np.r_[cut, len(own)], strict=True):
                        found[lo + i].append({"start": int(a), "stop": int(b), "lang": m.langs[own[a]]})
    names = np.array([*m.langs, UNDETERMINED], object)
    out = pd.DataFrame({"lang_pred": names[pred], "score": score, "evidence": evidence})
    return out.assign(spans=found) if spans else out


def identify(docs: DataFrame, model: LanguageModel | None, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, on demand, spans (word ranges with their language) of every document."""
    got = language_column(model, F.col("text"), docs.sparkSession, spans)
    out = docs.select("doc_id", held_out().alias("held_out"), got.alias("got"))
    named = [F.coalesce("got.lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("got.score", F.lit(0.0)).alias("score")]
    return out.select("doc_id", "held_out", *named, *["got.spans"] * spans)


def keep_identified(docs: DataFrame, least: float = 0.35, least_evidence: float = -4.0) -> DataFrame:
    """The documents, all their columns, whose language is known with a share of at least `least`.

    A text in a language or script that was not learned, or of random letters, would still get the nearest
    learned language; its trigrams are then far less likely than that language's own. Texts below
    least_evidence go too. (Texts of learned languages are above -2.5 but for a few short ones, others below -4.9.)
    """
    model = train(docs)
    got = language_column(model, F.col("text"), docs.sparkSession)
    return docs.filter(F.coalesce((got["lang_pred"] != UNDETERMINED) & (got["score"] >= least) & (got["evidence"] >= least_evidence), F.lit(False)))
