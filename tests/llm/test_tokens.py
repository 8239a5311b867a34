import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, piece_tokenizer
from tests.llm import cases

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
tokenizer = Tokenizer.from_file(BYTES)
texts = st.text(st.one_of(st.sampled_from("abcdeghinorst  \n\t.é漢ü€▁"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces_equal_the_library(text):
    m = piece_tokenizer.model(PIECES)
    ids = m.encode(text)
    assert ids == library.encode(text)
    assert m.decode([*ids, m.end_id]) == library.decode([*ids, m.end_id])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=20))
def test_decoding_any_ids_equals_the_library(ids):
    assert piece_tokenizer.model(PIECES).decode(ids) == library.decode(ids)


def test_long_words_and_spaces():
    m = piece_tokenizer.model(PIECES)
    for text in ("x" * 5000, " " * 500, "the" * 2000, " \n" * 300, "a" + " " * 33 + "€", "ab" * 3000 + "漢"):
        assert m.encode(text) == library.encode(text)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_byte_ids_equal_the_library(text):
    assert packing._encoder(BYTES)(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings_as_the_library_has_them():
    assert packing._encoder(BYTES)("a <|endoftext|> b") == tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_encode_odd_cases(spark):
    docs = cases.documents(spark)
    got = piece_tokenizer.encode(docs, PIECES).collect()
    want = sorted(([*library.encode(r.text or ""), 2] for r in docs.collect()), key=repr)
    assert sorted((list(r.ids) for r in got), key=repr) == want
    assert piece_tokenizer.encode(cases.empty(spark), PIECES, digests=True).count() == 0
    assert {r.n_tokens for r in piece_tokenizer.encode(cases.nulls(spark), PIECES).collect()} == {1}


def test_large_ids_beside_nulls_stay_exact(spark):
    ids = [2**53 + 1, None, 2**53 + 3, -(2**53) - 1]
    docs = cases.documents(spark, [(i, "some text") for i in ids])
    for out in (piece_tokenizer.encode(docs, PIECES, digests=True), piece_tokenizer.encode(docs, PIECES), packing.pack(docs, BYTES)):
        assert {r.doc_id for r in out.collect()} == set(ids)


def check_packing(docs, capacity=64, **more):
    rows = packing.pack(docs, BYTES, capacity=capacity, **more).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in at.values())
    want = []
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cut = [0, *range(first, len(ids) + 1, capacity)]
        want += [(d.doc_id, k, i, j - i, zlib.crc32(ids[i:j].tobytes())) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    total = sum(r.length for r in rows)
    return len(at), -(-total // capacity)


def test_packing_odd_cases(spark):
    check_packing(cases.documents(spark))
    check_packing(cases.nulls(spark))
    assert packing.pack(cases.empty(spark), BYTES).count() == 0


def test_packing_is_near_the_bound_over_many_shards(spark, small):
    used, bound = check_packing(spark.read.parquet(f"{small}/documents.parquet"), capacity=256, shard_pieces=40)
    assert used <= bound * 1.03 + 1


def test_search_beats_best_fit_and_elites_are_kept(spark):
    rng = np.random.default_rng(0)
    wins = 0
    for seed in range(12):
        lengths = np.minimum(1023, rng.gamma(2.2, 200, 300).astype(np.int64) + 1)
        start = packing._first(lengths, 1024, None)
        bound = -(-int(lengths.sum()) // 1024)
        first = [packing.evolve(lengths, 1024, 10 * seed + island, []) for island in (0, 1)]
        second = [packing.evolve(lengths, 1024, 100 + 10 * seed + island, [first[1 - island]]) for island in (0, 1)]
        best = [len(p[0]) for p in second]
        for sent, got in zip(first[::-1], second):  # an island is at least as good as the elite that it was sent
            assert packing._fitness(*got, 1024) <= packing._fitness(*sent, 1024)
        assert bound <= min(best) <= len(start[0])
        wins += min(best) < len(start[0])
    assert wins


def test_swaps_keep_pieces_and_empty_bins():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])
    bins, room = packing.swap_rooms(([[0, 5], [1, 3], [2, 4], [6]], [1, 1, 1, 7]), lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and all(lengths[b].sum() + r == 10 for b, r in zip(bins, room))
    assert len(bins) == 3  # the room of four bins was a bin's


def test_exact_fill_packs_everything():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 100, 300)
    bins, room = packing.exact_fill(lengths, 100, rng)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(lengths[b].sum() + r == 100 and r >= 0 for b, r in zip(bins, room))


def test_evolution_beats_or_equals_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(20, 60, 200)
    start, room = [], []
    packing.best_fit(lengths, list(range(200)), start, room, 100)
    bins, left = packing.evolve(lengths, 100, 1, [(start, room)], generations=20)
    assert len(bins) <= len(start) and sorted(i for b in bins for i in b) == list(range(200))
    assert all(lengths[b].sum() + r == 100 for b, r in zip(bins, left))
