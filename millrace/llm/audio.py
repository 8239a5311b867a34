"""Audio columns: 8-bit PCM media, polyphase resampling, log-mel frames and energy segments.

`store` writes bytes losslessly as the samples of a WAV file in a media column; `features` reads the media
back, resamples by a rational factor with a windowed-sinc polyphase filter, takes overlapped frames and
their log-mel energies, and cuts the signal into segments by two energy thresholds: a segment opens above
the upper and closes below the lower. It writes a feature table of which each row is a pack of about
PACK_BYTES of features: three Arrow streams, of the pack's documents, of their patches, each a fixed-shape
tensor of PATCH frames x MELS with its time span, and of their segments with theirs. Packs are columns of a
Parquet table that Spark commits, so retries and lost executors leave nothing behind. `patches`, `segments`
and `digests` read that table.

A payload is the text's UTF-8 bytes and then spaces up to a positive multiple of 192, so null and
empty texts have 192 bytes. Null ids are kept; repeated rows get equal values; equal texts get equal
values, as nothing else is an input. A long text is a pack of its own. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import fresh_path

RATE = 8000  # samples a second of the stored media
UP, DOWN = 3, 4
TAPS = 8  # of each polyphase branch, on either side of the centre
FRAME, HOP = 256, 128  # of the resampled signal: half of every frame overlaps the next
MELS = 16
PATCH = 8  # frames in a tensor
STEP = HOP / (RATE * UP / DOWN)  # seconds from frame to frame
UPPER, LOWER = 2.0, -2.0  # decibels over the median energy
PAD_TO = 192
PACK_BYTES = 2 << 20
MEDIA = "doc_id long, n_bytes long, media binary"
PACK = "documents binary, patches binary, segments binary"
TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
#: The three streams of a pack; `row` is a document's place in its pack.
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
PATCHES = pa.schema([("row", pa.int32()), ("patch", pa.int32()), ("frames", pa.int32()), ("start", pa.float64()), ("stop", pa.float64()), ("mel", TENSOR)])
SEGMENTS = pa.schema([("row", pa.int32()), ("start", pa.float64()), ("stop", pa.float64())])
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file (mono, unsigned 8-bit PCM) whose samples are the payload's bytes."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def decode(media: bytes) -> tuple[bytes, int]:
    """The samples of a WAV file of this kind and its rate."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _branches() -> np.ndarray:
    """The filter's UP branches over a window of DOWN + 2 * TAPS input samples, as a matrix."""
    width = DOWN + 2 * TAPS
    cutoff = 1.0 / max(1.0, DOWN / UP)
    out = np.zeros((width, UP), np.float32)
    for phase in range(UP):
        centre = TAPS + phase * DOWN / UP
        t = np.arange(width) - centre
        window = np.where(np.abs(t) <= TAPS, 0.5 + 0.5 * np.cos(np.pi * t / TAPS), 0)
        h = cutoff * np.sinc(cutoff * t) * window
        out[:, phase] = h / h.sum()
    return out


def resample(x: np.ndarray) -> np.ndarray:
    """UP / DOWN times as many samples, every block of DOWN input samples giving UP outputs."""
    padded = np.concatenate([np.full(TAPS, x[0], np.float32), x, np.full(TAPS + (-len(x)) % DOWN, x[-1], np.float32)])
    blocks = -(-len(x) // DOWN)
    view = np.lib.stride_tricks.as_strided(padded, (blocks, DOWN + 2 * TAPS), (DOWN * padded.strides[0], padded.strides[0]))
    return (np.ascontiguousarray(view) @ _branches()).ravel()


@cache
def _mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    freq = np.linspace(0, top, FRAME // 2 + 1)
    rise = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@cache
def _window() -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and log energy of every frame; the last one is padded."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for lo in range(0, n, 4096):  # bounds the memory for long texts
        m = min(4096, n - lo)
        frames = np.lib.stride_tricks.as_strided(padded[lo * HOP :], (m, FRAME), (HOP * 4, 4)) * _window()
        power = np.fft.rfft(frames, axis=1)
        power = power.real**2 + power.imag**2
        mel[lo : lo + m] = np.log(power.astype(np.float32) @ _mel_bank() + 1e-6)
        energy[lo : lo + m] = 10 * np.log10((frames * frames).mean(1) + 1e-9)
    return mel, energy


def segments_of(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that rise above the upper threshold and have not fallen below the lower one."""
    level = energy - np.median(energy)
    mark = np.where(level >= UPPER, 1, np.where(level < LOWER, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    on = mark[last] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def describe(samples: bytes) -> tuple[np.ndarray, int, list[tuple[float, float]]]:
    """Of a payload: patches of log-mel frames (the last one padded with zeros), the number of frames, and segments in seconds."""
    y = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    mel, energy = log_mel(y)
    tensor = np.zeros((-(-len(mel) // PATCH), PATCH, MELS), np.float32)
    tensor.reshape(-1, MELS)[: len(mel)] = mel
    return tensor, len(mel), [(a * STEP, (b + 1) * STEP) for a, b in segments_of(energy)]


def feature(mel: np.ndarray, frames: int, spans: list[tuple[float, float]]) -> str:
    """A short text of a document's patches and segments."""
    means = " ".join(f"{v:.2f}" for v in mel.reshape(-1, MELS)[:frames].mean(0, dtype=np.float64))
    loud = sum(b - a for a, b in spans)
    return f"frames={frames} segments={len(spans)} loud={loud:.3f}s mel={means}"


def _stream(columns: list, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    return sink.getvalue().to_pybytes()


def _read(stream: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(stream) as got:
        return got.read_next_batch()


def tensors(mel: list[np.ndarray]) -> pa.ExtensionArray:
    """Patches as an Arrow array of fixed-shape tensors."""
    flat = np.concatenate([m.reshape(-1) for m in mel]) if mel else np.zeros(0, np.float32)
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat), PATCH * MELS))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """One pack of rows of DOCUMENTS' values, patches, number of frames and segments."""
    mel = [r[1] for r in rows]
    counts = np.array([len(m) for m in mel])
    patch = np.concatenate([np.arange(n) for n in counts]).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    frames = np.minimum(PATCH, np.repeat([r[2] for r in rows], counts) - patch * PATCH)
    documents = _stream(list(zip(*(r[0] for r in rows), strict=True)), DOCUMENTS)
    patches = _stream([row, patch, frames.astype(np.int32), patch * (PATCH * STEP), ((patch + 1) * PATCH + 1) * STEP, tensors(mel)], PATCHES)
    spans = [(i, a, b) for i, r in enumerate(rows) for a, b in r[3]]
    segments = _stream([[s[k] for s in spans] for k in range(3)], SEGMENTS)
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (documents, patches, segments)], names=["documents", "patches", "segments"])


def store(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write every text as a media column of a Parquet table and return that table, read from there."""
    path = path or fresh_path(docs.sparkSession, "media")

    def to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raw = [t or b"" for t in part["payload"].to_pylist()]
                media = [encode(b + b" " * (-len(b) % PAD_TO if b else PAD_TO)) for b in raw]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("payload"))
    rows.mapInArrow(to_media, MEDIA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def features(media: DataFrame, path: str | None = None) -> DataFrame:
    """Write the feature table of a media table and return it, read from there: packs of documents, patches and segments."""
    path = path or fresh_path(media.sparkSession, "features")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, n_bytes, data = (batch[c][i].as_py() for c in ("doc_id", "n_bytes", "media"))
                samples, _ = decode(data)
                found = describe(samples)
                if rows and size + found[0].nbytes > PACK_BYTES:
                    yield _packed(rows)
                    rows, size = [], 0
                digests = (doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest())
                rows.append((digests, *found))
                size += found[0].nbytes
        if rows:
            yield _packed(rows)

    media.select("doc_id", "n_bytes", "media").mapInArrow(compute, PACK).write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def _slices(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def digests(packs: DataFrame) -> DataFrame:
    """doc_id, sizes, checksums and the feature text of every document of a feature table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                documents, patches, segments = (_read(batch[c][i].as_py()) for c in ("documents", "patches", "segments"))
                n = documents.num_rows
                mel, frames = patches["mel"].to_numpy_ndarray(), patches["frames"].to_numpy()
                spans = list(zip(segments["start"].to_pylist(), segments["stop"].to_pylist(), strict=True))
                at, seg = _slices(patches["row"].to_numpy(), n), _slices(segments["row"].to_numpy(), n)
                texts = [feature(mel[at[k] : at[k + 1]], int(frames[at[k] : at[k + 1]].sum()), spans[seg[k] : seg[k + 1]]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*documents.columns, pa.array(texts, pa.string())], names=[*DOCUMENTS.names, "feature"])

    return packs.mapInArrow(read, DIGESTS)


def _parts(packs: DataFrame, stream: str, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, part = _read(batch["documents"][i].as_py())["doc_id"], _read(batch[stream][i].as_py())
                plain = {n: part[n] for n in part.schema.names if n != "mel"} | {"doc_id": ids.take(part["row"])}
                if stream == "patches":
                    offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (PATCH * MELS))
                    plain["mel"] = pa.ListArray.from_arrays(offsets, part["mel"].storage.flatten())
                yield pa.RecordBatch.from_arrays([plain[n] for n in names], names=names)

    return packs.mapInArrow(read, schema)


def patches(packs: DataFrame) -> DataFrame:
    """doc_id, patch, frames, start and stop (seconds) and mel (PATCH x MELS numbers, row by row) of every patch of a feature table."""
    return _parts(packs, "patches", "doc_id long, patch int, frames int, start double, stop double, mel array<float>")


def segments(packs: DataFrame) -> DataFrame:
    """doc_id, start and stop (seconds) of every segment of a feature table."""
    return _parts(packs, "segments", "doc_id long, start double, stop double")
