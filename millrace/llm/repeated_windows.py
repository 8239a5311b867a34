"""Removal of byte windows that a document with a smaller id has too.

A window is WINDOW bytes of the UTF-8 text. Every byte of a window that also starts in a document
with a smaller id is removed; windows are judged on the input and never cross documents.

Suffixes are ordered by a radix sort from the most significant digit that ends at the window's depth.
Each window's suffix is entered at its anchor, the leftmost of its 24-byte strings with the least hash,
which equal windows share at the same place. Pass 1 orders anchors by the leading digits of the
24-byte hash (the bucket), then within a bucket by the rest; strings of one document only leave the sort. Within
a group of equal strings, pass 2 goes down to the whole span of windows that has this anchor: an equal
span of a smaller document settles all of them. Where a group has several spans, pass 3 orders their
single windows to the full depth; groups that are equal then are the repeated windows.

Bytes are compared by hashes: spans by 48 bits of the anchor and 64 of the whole span, windows by 112 bits of
the window and its anchor. Different strings of one anchor with M contexts are taken for equal with
a chance of about M * M / 2 ** 65 (3e-6 at 10 million), those of different anchors, N in all, with N * N / 2 ** 113.

Documents are dealt into splits by a hash of the id; a split sends one packed array a bucket in which
every string occurs once, so a passage that a third of all documents share is as many entries as there
are splits. Answers come back as bits in the order of the entries.

Null texts count as empty. Rows with a null id keep their text whole and are no one's source.
Repeated ids: rows of one id are no source of each other. Ids order as integers. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm._common import text_bytes
from millrace.llm._text import mix

WINDOW = 50
ANCHOR = 24
SPLIT_BYTES, SPLIT_MOST = 4 << 20, 64 << 20  # a split's task holds some eight times its bytes
ARRAY_BYTES = 16 << 10
CHUNK = 1 << 20
NO_ID = np.iinfo(np.int64).min

_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the usual length."""
    size = max(n, CHUNK + (1 << 16))
    if size not in _POWERS:
        if size > CHUNK + (1 << 16):
            return _power_arrays(size)
        _POWERS[size] = _power_arrays(size)
    return _POWERS[size]


def _power_arrays(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_R, _R_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Spans:
    """The windows of some texts, grouped in spans of neighbouring windows with one anchor.

    first, count: of each span's windows in buf; anchor, content: hashes of its anchor and of all its
    bytes; doc: index of its text.
    """

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.r_[0, np.cumsum(lengths)]
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.buf)
        starts = lengths - WINDOW + 1
        some = np.flatnonzero(starts > 0)
        if not len(some):
            self.first = self.count = self.doc = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        sums, inverse = self._sums()
        grams = (sums[ANCHOR:] - sums[: n + 1 - ANCHOR]) * inverse[: n + 1 - ANCHOR]
        key = (mix(grams) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        w = WINDOW - ANCHOR + 1
        least, span = key, 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(key) - w + 1], least[w - span :])
        # window starts of all texts, one after another
        at = np.repeat(self.offsets[some] - (np.cumsum(starts[some]) - starts[some]), starts[some]) + np.arange(int(starts[some].sum()))
        place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.first = at[new]
        self.count = np.diff(np.r_[new, len(at)])
        self.anchor = mix(grams[place[new]] ^ np.uint64(0x2545F4914F6CDD1D))
        content = (sums[self.first + self.count + WINDOW - 1] - sums[self.first]) * inverse[self.first]
        self.content = mix(content + (place[new] - self.first).astype(np.uint64))
        self.doc = np.searchsorted(self.offsets, self.first, side="right") - 1

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the bytes' values times powers, and the inverse powers; made anew when needed, as they take 8 bytes for each byte of text."""
        n = len(self.buf)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * power[:n], out=sums[1:])
        return sums, inverse

    def starts(self, spans: np.ndarray) -> np.ndarray:
        """Where the windows of these spans start."""
        count = self.count[spans]
        return np.repeat(self.first[spans] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))

    def windows(self, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all windows of these spans: span and a hash."""
        start = self.starts(spans)
        sums, inverse = self._sums()
        hashes = mix(((sums[start + WINDOW] - sums[start]) * inverse[start]) ^ np.uint64(0x5851F42D4C957F2D))
        return np.repeat(spans, self.count[spans]), hashes


def _chunks(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, Spans]]:
    """The spans of the texts, about CHUNK bytes at a time; a longer text is a chunk of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield ids[begin:i], Spans(texts[begin:i])
            begin, size = i, 0
        size += len(t)
    yield ids[begin:], Spans(texts[begin:])


KEY_BITS = 48
RAW_PLANES = 4  # the lower bytes of differences are random, the others mostly 0


def _pack(keys: np.ndarray, ids: np.ndarray, second: np.ndarray) -> bytes:
    """Sorted keys of KEY_BITS as differences, byte planes apart, ids as places in a list of ids, and all 64 bits of the second hash."""
    names, places = np.unique(ids, return_inverse=True)
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    parts = [planes[:, k].tobytes() if k < RAW_PLANES else zlib.compress(planes[:, k].tobytes(), 1) for k in range(KEY_BITS // 8)]
    width = 2 if len(names) < 65536 else 4
    by_byte = places.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    parts += [by_byte[:, k].tobytes() if k == 0 else zlib.compress(by_byte[:, k].tobytes(), 1) for k in range(width)]
    names = zlib.compress(names.astype("<i8").tobytes(), 1)
    head = np.array([len(keys), width, len(names), *map(len, parts)], "<i8").tobytes()
    return head + names + b"".join(parts) + second.astype("<u8").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width, n_names = np.frombuffer(blob, "<i8", 3).tolist()
    sizes = np.frombuffer(blob, "<i8", KEY_BITS // 8 + width, 24).tolist()
    at = 24 + 8 * len(sizes)
    names = np.frombuffer(zlib.decompress(blob[at : at + n_names]), "<i8")
    at += n_names
    planes, by_byte = np.zeros((n, 8), np.uint8), np.zeros((n, width), np.uint8)
    for k, size in enumerate(sizes):
        raw = blob[at : at + size]
        to, plain = (planes[:, k], k < RAW_PLANES) if k < KEY_BITS // 8 else (by_byte[:, k - KEY_BITS // 8], k == KEY_BITS // 8)
        to[:] = np.frombuffer(raw if plain else zlib.decompress(raw), np.uint8)
        at += size
    keys = np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)
    return keys, names[by_byte.view(f"<u{width}").ravel()], np.frombuffer(blob, "<u8", n, at)


def _first_of(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (sorted): the place of an entry of each, its smallest id, and for each entry its key's place."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], ids[order[new]], group


class _Split:
    """The spans of a split's texts and, for passes 1 and 3, its entries in the order in which answers come."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], buckets: int):
        self.ids, self.texts, self.buckets = ids, texts, buckets
        self.parts = [(own, s) for own, s in _chunks(ids, texts)]
        doc = np.concatenate([own[s.doc] if len(s.doc) else np.zeros(0, np.int64) for own, s in self.parts])
        self.known = doc != NO_ID
        self.doc = doc[self.known]
        anchor = np.concatenate([s.anchor for _, s in self.parts])[self.known] >> np.uint64(64 - KEY_BITS)
        content = np.concatenate([s.content for _, s in self.parts])[self.known]
        at, self.least, self.group = _first_of([anchor, content], self.doc)
        self.anchor, self.content = anchor[at], content[at]

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        """Ranges of keys, so entries sorted by key are sorted by bucket."""
        return (hashes >> np.uint64(KEY_BITS - 32)) * np.uint64(self.buckets) >> np.uint64(32)

    def entries(self) -> Iterator[tuple[int, bytes]]:
        yield from self._packed(self.anchor, self.least, self.content)

    def _packed(self, hashes, ids, content) -> Iterator[tuple[int, bytes]]:
        bucket = self.bucket(hashes)
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            part = slice(cut[b], cut[b + 1])
            yield int(b), _pack(hashes[part], ids[part], content[part])

    def settle(self, answers: dict[int, bytes]) -> None:
        """Read pass 1's answers: 1 where a smaller document has the span, 2 where the group has several spans."""
        got = np.concatenate([np.frombuffer(zlib.decompress(answers[b]), np.uint8) for b in sorted(answers)]) if answers else np.zeros(0, np.uint8)
        here = got[self.group]
        self.gone = ((here & 1) > 0) | (self.least[self.group] < self.doc)
        # of the copies of a span in this split one is enough; the others are gone or repeat it
        self.open = ((here & 2) > 0) & ~self.gone
        bounds = np.cumsum([0] + [len(s.first) for _, s in self.parts])
        places = np.flatnonzero(self.known)
        self.open_of = [places[self.open][np.searchsorted(places[self.open], a) : np.searchsorted(places[self.open], b)] - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.gone_of = [places[self.gone][np.searchsorted(places[self.gone], a) : np.searchsorted(places[self.gone], b)] - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rows = [(own, s, *s.windows(o)) for (own, s), o in zip(self.parts, self.open_of, strict=True) if len(o)]
        empty = np.zeros(0, np.int64)
        w_hash = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.uint64)
        self.w_doc = np.concatenate([own[s.doc[span]] for own, s, span, _ in rows]) if rows else empty
        w_anchor = np.concatenate([s.anchor[span] for _, s, span, _ in rows]) if rows else np.zeros(0, np.uint64)
        # the window's other bits go into the second hash
        second = mix(w_anchor + (w_hash & np.uint64((1 << (64 - KEY_BITS)) - 1)) * _R)
        w_hash = w_hash >> np.uint64(64 - KEY_BITS)
        at, self.w_least, self.w_group = _first_of([w_hash, second], self.w_doc)
        self.w_keys, self.w_second = w_hash[at], second[at]

    def window_entries(self) -> Iterator[tuple[int, bytes]]:
        yield from self._packed(self.w_keys, self.w_least, self.w_second)

    def covered(self, answers: dict[int, bytes]) -> Iterator[np.ndarray]:
        """For each text which of its bytes are removed."""
        got = np.concatenate([np.frombuffer(zlib.decompress(answers[b]), np.uint8) for b in sorted(answers)]) if answers else np.zeros(0, np.uint8)
        repeated = ((got[self.w_group] & 1) > 0) | (self.w_least[self.w_group] < self.w_doc)
        used = 0
        for (_, s), gone, still in zip(self.parts, self.gone_of, self.open_of, strict=True):
            edge = np.zeros(len(s.buf) + 1, np.int32)
            np.add.at(edge, s.first[gone], 1)
            np.add.at(edge, s.first[gone] + s.count[gone] + WINDOW - 1, -1)
            if len(still):
                start = s.starts(still)
                hit = start[repeated[used : used + len(start)]]
                used += len(start)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + WINDOW, -1)
            mask = np.cumsum(edge[:-1]) > 0
            for i, j in zip(s.offsets[:-1], s.offsets[1:], strict=True):
                yield mask[i:j]


def _judge(spans: bool) -> Callable[[pa.Table], pa.Table]:
    """A bucket's entries, sorted; for each of them whether a smaller document has it and, of spans, whether its group divides."""

    def judge(table):
        splits, blobs = table["split"].to_pylist(), table["packed"].to_pylist()
        parts = [_unpack(b) for b in blobs]
        sizes = np.cumsum([0] + [len(p[0]) for p in parts])
        hashes, ids, content = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, least, group = _first_of([hashes, content], ids)
        answer = least[group] < ids
        if spans:
            _, group_of = np.unique(hashes[at], return_inverse=True)
            several = (np.bincount(group_of) > 1)[group_of][group]
            answer = answer + 2 * several.astype(np.uint8)
        answer = answer.astype(np.uint8)
        packed = [zlib.compress(answer[i:j].tobytes(), 1) for i, j in zip(sizes[:-1], sizes[1:], strict=True)]
        return pa.table({"split": pa.array(splits, pa.int32()), "bucket": table["bucket"], "answer": pa.array(packed, pa.binary())})

    return judge


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    ids = table["doc_id"].fill_null(NO_ID).to_numpy()
    order = np.argsort(table["row"].to_numpy(), kind="stable")
    raw = table["text"].to_pylist()
    return ids[order], [raw[i] or b"" for i in order], order


def _answers(table: pa.Table, stage: int) -> dict[int, bytes]:
    own = table.filter(pc.equal(table["stage"], stage))
    return dict(zip(own["bucket"].to_pylist(), own["answer"].to_pylist(), strict=True))


def remove_repeats(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    On demand also kept (the remaining text, without bytes of characters that a cut has split; null for a
    null text) and rest (a struct of the row's other columns).
    """
    total = text_bytes(docs)
    # every split sends an array to every bucket: beyond a GB their numbers grow with the root of the input, so
    # arrays keep a size worth sending, until splits have reached the most that a task should hold
    n_splits = max(1, -(-total // SPLIT_MOST), min(-(-total // SPLIT_BYTES), int((total / ARRAY_BYTES) ** 0.5)))
    n_buckets = n_splits
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] if keep_rows else [F.lit(0).alias("none")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.struct(*others).alias("rest"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("split", F.pmod(F.xxhash64(F.lit(5), "doc_id", "row"), F.lit(n_splits)).cast("int"))
    width = max(1, min(n_splits, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    dealt = rows.repartition(width, "split")
    entry = "split int, bucket int, packed binary"
    rest = dealt.schema["rest"].dataType.simpleString()
    rest_type = to_arrow_type(T._parse_datatype_string(rest))  # every field may be null there

    def enter(key, table):
        ids, texts, _ = _texts(table)
        got = list(_Split(ids, texts, n_buckets).entries())
        return _entries(key[0].as_py(), got)

    def _entries(split: int, got: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table({"split": pa.array([split] * len(got), pa.int32()), "bucket": pa.array([b for b, _ in got], pa.int32()), "packed": pa.array([p for _, p in got], pa.binary())})

    def enter_windows(key, left, right):
        ids, texts, _ = _texts(left)
        split = _Split(ids, texts, n_buckets)
        split.settle(_answers(right, 1))
        return _entries(key[0].as_py(), list(split.window_entries()))

    def finish(_key, left, right):
        ids, texts, order = _texts(left)
        left = left.take(pa.array(order))
        split = _Split(ids, texts, n_buckets)
        split.settle(_answers(right, 1))
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for t, null, mask in zip(texts, left["text"].is_null().to_pylist(), split.covered(_answers(right, 2)), strict=True):
            kept = np.frombuffer(t, np.uint8)[~mask].tobytes() if mask.any() else t
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(None if not keep_rows or null else kept.decode("utf-8", "ignore"))
        return pa.table(
            {
                "doc_id": left["doc_id"], "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.string()), "rest": left["rest"].cast(rest_type),
            }
        )

    answer = "split int, bucket int, answer binary"
    first = dealt.groupBy("split").applyInArrow(enter, entry).groupBy("bucket").applyInArrow(_judge(True), answer).withColumn("stage", F.lit(1))
    again = dealt.groupBy("split").cogroup(first.groupBy("split")).applyInArrow(enter_windows, entry)
    second = again.groupBy("bucket").applyInArrow(_judge(False), answer).withColumn("stage", F.lit(2))
    both = first.unionByName(second)
    kept = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, rest {rest}"
    out = dealt.groupBy("split").cogroup(both.groupBy("split")).applyInArrow(finish, kept)
    return out if keep_rows else out.drop("kept", "rest")


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, with repeated windows cut from the text and n_chars as it is then.

    Bytes of a character that a cut has split are dropped. A null text stays null.
    """
    found = remove_repeats(docs, keep_rows=True)
    columns = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in columns:
        cut = F.length("kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, cut).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])
