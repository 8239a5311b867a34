import hashlib
import zlib

import numpy as np
import pyarrow as pa

from millrace.llm import audio, topk_search
from millrace.llm.queries import TOPK_SQL, op10_topk
from tests.compare import duck_rows, rows_of
from tests.llm import cases


def test_top_k_equals_its_sql(spark, small):
    assert rows_of(op10_topk(spark, small)) == duck_rows(TOPK_SQL, small)


def vectors(spark, rows):
    return topk_search.quantised(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, shard string, block int"))


def brute(rows, k):
    ok = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, -n) for r, (n, i) in enumerate(s, 1)]
    return sorted(out)


def test_top_k_odd_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(i, [0.5] * 8) for i in range(200, 240)]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [float("inf")] * 8), (304, []), (None, [1.0] * 8), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (500, [0.0] * 8)]
    v = vectors(spark, rows)
    for shard, block in ((40, 2), (4096, 1024)):
        got = topk_search.top_k(v, v.filter("vec_id % 100 = 0"), k=5, shard_rows=shard, block_rows=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5)
    none = v.filter("false")
    assert topk_search.top_k(none, none).count() == 0 and topk_search.top_k(v, none).count() == 0


def test_top_k_is_exact_beyond_floating_point(spark):
    rng = np.random.default_rng(2)
    for scale, k in ((1e5, 5), (3e9, 5)):
        rows = [(i, (rng.normal(size=16) * scale).tolist()) for i in range(400)]
        v = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got = topk_search.top_k(v, v.filter("vec_id % 100 = 0"), k=k, shard_rows=64, block_rows=2).collect()
        ints = {i: [int(np.floor(1024 * np.float64(x))) for x in x] for i, x in rows}
        want = []
        for q in (0, 100, 200, 300):
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:k]
            want += [(q, r, i, min(-n, 2**63 - 1)) for r, (n, i) in enumerate(best, 1)]
        if scale == 1e5:
            assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
        else:  # beyond a long the score is the largest one
            assert {(r.query_id, r.score) for r in got} == {(q, n) for q, _, _, n in want}


def test_wav_round_trip():
    for payload in (b"", b"a", bytes(range(256)), b"x" * 1001):
        assert audio.decode(audio.encode(payload)) == (payload, audio.RATE)


def plain_mel(samples):
    """Log-mel frames by direct sums: no matrix of branches, no FFT."""
    x = np.array([(b - 128) / 128 for b in samples])
    taps, up, down = audio.TAPS, audio.UP, audio.DOWN
    padded = np.concatenate([np.full(taps, x[0]), x, np.full(taps + (-len(x)) % down, x[-1])])
    y = []
    for block in range(-(-len(x) // down)):
        for phase in range(up):
            weights, total = [], 0.0
            for t in range(down + 2 * taps):
                d = t - (taps + phase * down / up)
                cutoff = up / down
                weights.append(cutoff * np.sinc(cutoff * d) * (0.5 + 0.5 * np.cos(np.pi * d / taps)) if abs(d) <= taps else 0.0)
            total = sum(w * padded[block * down + t] for t, w in enumerate(weights))
            y.append(total / sum(weights))
    frames = max(1, -(-max(0, len(y) - audio.FRAME) // audio.HOP) + 1)
    y = np.concatenate([y, np.zeros((frames - 1) * audio.HOP + audio.FRAME - len(y))])
    n, rate = audio.FRAME, audio.RATE * up / down
    k = np.arange(n // 2 + 1)
    dft = np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hz(m) for m in np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), audio.MELS + 2)]
    out = np.zeros((frames, audio.MELS))
    for f in range(frames):
        part = y[f * audio.HOP : f * audio.HOP + n] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))
        power = np.abs(dft @ part) ** 2
        for m in range(audio.MELS):
            lo, mid, hi = edges[m : m + 3]
            w = [max(0.0, min((h - lo) / (mid - lo), (hi - h) / (hi - mid))) for h in k * rate / n]
            out[f, m] = np.log(np.dot(w, power) + 1e-6)
    return out


def test_audio_rows(spark, monkeypatch):
    monkeypatch.setattr(audio, "PACK_BYTES", 4096)  # several packs
    docs = cases.documents(spark)
    packs = audio.features(audio.store(docs))
    got = audio.digests(packs).collect()
    want = []
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(audio.encode(p)).hexdigest()))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got), key=repr) == sorted(want, key=repr)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r.payload_sha256, r.feature) == r.feature
    for none, n in ((cases.empty(spark), 0), (cases.nulls(spark), 2)):
        assert audio.digests(audio.features(audio.store(none))).count() == n


def test_stored_tensors_equal_direct_sums(spark):
    rows = [(1, "a few words " * 90), (2**53 + 1, "Größe"), (None, "x" * 700)]
    packs = audio.features(audio.store(cases.documents(spark, rows)))
    stream = packs.first().patches
    assert pa.ipc.open_stream(stream).schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.PATCH, audio.MELS))
    patches = sorted(audio.patches(packs).collect(), key=lambda r: (r.doc_id or 0, r.patch))
    spans = audio.segments(packs).collect()
    feature = {r.doc_id: r.feature for r in audio.digests(packs).collect()}
    assert set(feature) == {1, 2**53 + 1, None}
    for doc_id, text in rows:
        payload = text.encode()
        mel = plain_mel(payload + b" " * (-len(payload) % 192))
        own = [r for r in patches if r.doc_id == doc_id]
        assert [r.patch for r in own] == list(range(-(-len(mel) // audio.PATCH))) and sum(r.frames for r in own) == len(mel)
        stored = np.concatenate([np.reshape(r.mel, (audio.PATCH, audio.MELS))[: r.frames] for r in own])
        assert np.allclose(stored, mel, atol=2e-3)
        assert [(round(r.start, 6), round(r.stop, 6)) for r in own] == [(round(k * 8 * 128 / 6000, 6), round(((k + 1) * 8 + 1) * 128 / 6000, 6)) for k in range(len(own))]
        segs = [(s.start, s.stop) for s in spans if s.doc_id == doc_id]
        means = " ".join(f"{v:.2f}" for v in stored.mean(0, dtype=np.float64))
        assert feature[doc_id] == f"frames={len(mel)} segments={len(segs)} loud={sum(b - a for a, b in segs):.3f}s mel={means}"


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 6000 and abs(np.abs(np.fft.rfft(y)).argmax() - 440) <= 1


def test_segments_have_hysteresis():
    level = np.array([0, 0, 0, 5, 1, 0, -1, -5, 0, 1, 0], np.float32)
    assert audio.segments_of(level) == [(3, 7)]
