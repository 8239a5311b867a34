import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import repeated_windows as rw
from tests.llm import cases


def brute(rows):
    """(id, text): kept bytes of each row; owners are smaller ids only."""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rw.remove_repeats(docs).collect()), key=repr)


def test_odd_cases_equal_brute_force(spark):
    docs = cases.documents(spark)
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert run(cases.empty(spark)) == []
    assert run(cases.nulls(spark)) == brute([(None, None)] * 2)


def test_random_passages_over_many_splits(spark, monkeypatch):
    monkeypatch.setattr(rw, "SPLIT_BYTES", 1500)
    monkeypatch.setattr(rw, "ARRAY_BYTES", 1)
    monkeypatch.setattr(rw, "CHUNK", 400)
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("ab é") for _ in range(rnd.choice((30, 49, 50, 51, 90, 200)))) for _ in range(12)]
    rows = [(rnd.randrange(40), "".join(rnd.choice(pool) if rnd.random() < 0.6 else "".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(6)))) for _ in range(60)]
    assert run(cases.documents(spark, rows)) == brute(rows)


def test_runs_of_one_character(spark):
    rows = [(1, "a" * 49), (2, "a" * 50), (3, "a" * 500 + "b"), (4, "b" + "a" * 60)]
    assert run(cases.documents(spark, rows)) == brute(rows)


def test_pipeline_form_keeps_columns(spark):
    docs = cases.documents(spark)
    out = rw.keep_unrepeated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert text[1].text == cases.LONG and text[2].text == "" and text[2].n_chars == 0 and text[4].text is None


def test_hashes_that_differ_in_their_low_bits_only_are_different():
    """Both hashes of an entry are compared whole."""
    ids, anchor = np.array([1, 2]), np.full(2, 99 << 40, np.uint64)
    content = np.array([7 << 40, (7 << 40) + 1], np.uint64)
    for spans in (True, False):
        blob = rw._pack(anchor, ids, content)
        table = pa.table({"split": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()), "packed": pa.array([blob], pa.binary())})
        answer = zlib.decompress(rw._judge(spans)(table)["answer"][0].as_py())
        assert [x & 1 for x in answer] == [0, 0], spans


def test_contents_that_share_their_upper_bits_do_not_settle_a_span(monkeypatch):
    """Two contexts of one phrase whose hashes are equal but for the low 24 bits: nothing is repeated."""
    made = rw.Spans.__init__

    def close(self, texts):
        made(self, texts)
        self.content = (self.content & np.uint64(0xFFFFFF)) | np.uint64(5 << 40)

    monkeypatch.setattr(rw.Spans, "__init__", close)
    phrase = "the same phrase of some forty bytes, here: "
    texts = [phrase.encode() + bytes([c]) * 20 for c in b"abcdef"]
    split = rw._Split(np.arange(6), texts, 1)
    answers = rw._judge(True)(pa.table({"split": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()), "packed": pa.array([b for _, b in split.entries()], pa.binary())}))
    split.settle({0: answers["answer"][0].as_py()})
    assert not split.gone.any()
