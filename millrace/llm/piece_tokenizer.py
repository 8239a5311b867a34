"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking.

The model file is read directly. A text is cut where no piece can reach across: before a space that
follows another character, and around characters that no longer piece has. Each part is encoded by
backtracking: an Aho-Corasick automaton finds the pieces that match at every place, the longest is tried
first, a piece may follow another only if merging the two anew gives the same two, and places from which
no encoding was found are marked in a bitfield. The result is what merging pairs by score gives.

Runs of spaces, whose pieces all have one score, are merged the way ties are: the leftmost first.
Null and empty texts encode to the end id alone. Very long texts and words take no special path.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MEMO_WORDS = 500_000  # parts kept by a worker between batches; all are dropped when there are more
MEMO_PAIRS = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """The pieces of a model file and the encoder's tables."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        normalizer: dict[int, object] = {}
        trainer: dict[int, object] = {}
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback that leave the text as it is are read")
        self.prefix = bool(normalizer.get(3, 1))
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.score = {p: scores[i] for p, i in self.id.items()}
        self.spelled = [p.replace(SPACE, " ") if k == NORMAL else chr(int(p[3:5], 16)) if k == BYTE and p < "<0x80>" else "" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.joining_ids = {i for i, k in enumerate(self.kinds) if k not in (NORMAL, CONTROL) and not self.spelled[i]}
        self.end_id = self.pieces.index("</s>")
        self.space_runs = {p for p in self.id if len(p) > 1 and not p.strip(SPACE)}
        inner = [p for p in self.id if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p not in self.space_runs)]
        if inner or len({self.score[p] for p in self.space_runs}) > 1:
            raise ValueError("pieces across spaces are not read")
        self.merged = {p for p in self.id if len(p) > 1 and p not in self.space_runs}
        joining = {c for p in self.merged for c in p}
        # a single character that is in no longer piece stands alone
        self.alone = re.compile(f"([^{re.escape(''.join(sorted(joining | {SPACE})))}])")
        lines = "" if "\n" in joining else "\n"  # lines are parts of their own, as words at their ends repeat
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+" + (f"|{lines}" if lines else ""))
        # in order of score: the place in the order, the last merge, and the longest shorter piece in front
        order = sorted(self.merged, key=lambda p: -self.score[p])
        self.rank = {p: i for i, p in enumerate(order)}
        self.split: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in order:
            last = self._merge(p)
            if last:  # pieces that merging never reaches can't occur
                self.split[p] = last
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.split), p[0]) for p in self.split}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _merge(self, text: str) -> tuple[str, str] | None:
        """The last merge that makes the text one piece, if merging pairs by score gets there."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(self.rank.get(x + y, len(self.rank)), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(pairs)
            if rank == len(self.rank):
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return None

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters anew gives the same two pieces.

        Merges are taken back, the latest first; at each moment the two parts that touch must not have been
        the better pair. Of equal pairs the leftmost is merged first.
        """
        rank, split = self.rank, self.split
        best = len(rank)
        while True:
            if rank.get(left + right, best) < best:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left > of_right:
                best, left = of_left, split[left][1]
            elif of_right < 0:
                return True
            else:
                best, right = of_right + 1, split[right][0]

    def _backtrack(self, text: str) -> list[str]:
        """The one sequence of pieces, each pair of neighbours compatible, that spells the text."""
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            longest[end - size + 1] = size  # ends ascend, so the last one is the longest
        pairs, shorter = self.pairs, self.shorter
        failed = 0  # bit i: nothing from place i on was found
        out: list[str] = []
        at, piece = 0, text[: longest[0]]
        while True:
            to = at + len(piece)
            good = not failed or not failed >> to & 1
            if good and out:
                pair = (out[-1], piece)
                good = pairs.get(pair)
                if good is None:
                    if len(pairs) >= MEMO_PAIRS:
                        pairs.clear()
                    good = pairs[pair] = self._fits(*pair)
            if good:
                out.append(piece)
                if to == n:
                    return out
                at, piece = to, text[to : to + longest[to]]
                continue
            while len(piece) == 1:  # no shorter piece: this place is a dead end
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
            piece = shorter[piece]

    def _spaces(self, n: int) -> list[str]:
        """A run of spaces, merged the leftmost pair first as all scores are equal."""
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(i, 2) for i in range(n - 1) if SPACE * 2 in self.space_runs]
        heapq.heapify(queue)
        alive = [True] * n
        while queue:
            i, total = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or size[i] + size[j] != total:
                continue
            size[i], alive[j], after[i] = total, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if SPACE * (size[i] + size[after[i]]) in self.space_runs:
                    heapq.heappush(queue, (i, size[i] + size[after[i]]))
            b = before[i]
            if b >= 0 and SPACE * (size[b] + size[i]) in self.space_runs:
                heapq.heappush(queue, (b, size[b] + size[i]))
        return [SPACE * size[i] for i in range(n) if alive[i]]

    def _word(self, part: str) -> tuple[int, ...]:
        if not part.startswith(SPACE, 1) and not self.alone.search(part):  # the usual case: one space, if any
            return self._run(part)
        return self._spaced(part)

    def _run(self, text: str) -> tuple[int, ...]:
        """The ids of characters that may all merge, or of a single one."""
        found = self._backtrack(text) if len(text) > 1 else [text]
        try:
            return tuple([self.id[p] for p in found])
        except KeyError:  # a character without a piece of its own
            return tuple(i for p in found for i in ((self.id[p],) if p in self.id else (self.byte_id[b] for b in p.encode("utf-8"))))

    def _spaced(self, part: str) -> tuple[int, ...]:
        """The same with a run of spaces in front, or with characters that stand alone."""
        spaces = len(part) - len(part.lstrip(SPACE))
        out: list[str] = []
        for k, run in enumerate(x for x in self.alone.split(part[max(0, spaces - 1) :]) if x):
            found = self._backtrack(run) if len(run) > 1 else [run]
            if k == 0 and spaces:
                own = spaces if found[0] == SPACE else spaces - 1
                out += self._spaces(own)
                found = found[1:] if found[0] == SPACE else found
            out += found
        ids: list[int] = []
        for p in out:
            if p in self.id:
                ids.append(self.id[p])
            else:
                ids += [self.byte_id[b] for b in p.encode("utf-8")]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without control ids."""
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        out: list[int] = []
        words = self.words
        for part in self.parts.findall(SPACE + marked if self.prefix else marked):
            ids = words.get(part)
            if ids is None:
                if len(words) >= MEMO_WORDS:
                    words.clear()
                ids = self._word(part)
                if len(part) <= 64:
                    words[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined to characters where they can be, one space in front goes.

        Bytes below 128 are characters whatever stands beside them; only the others need their neighbours.
        """
        if self.joining_ids.isdisjoint(ids):
            text = "".join([self.spelled[i] for i in ids])
            return text[1:] if self.prefix and ids and text.startswith(" ") and self.kinds[next((i for i in ids if self.spelled[i]), 0)] == NORMAL else text
        kinds, pieces = self.kinds, self.pieces
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            kind = kinds[i]
            if kind == BYTE:
                raw.append(int(pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw.clear()
            if kind == NORMAL:
                out.append(pieces[i])
            elif kind == UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(_characters(bytes(raw)))
        text = "".join(out)
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def _characters(raw: bytes) -> str:
    """Valid UTF-8 as characters, every other byte as U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def model(path: str) -> PieceModel:
    """The model of a path, once a worker."""
    return PieceModel(path)


ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (an end id last) and the text decoded from them; or their digests instead."""
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED

    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                out = []
                for text in part["text"].to_pylist():
                    ids = [*m.encode(text or ""), m.end_id]
                    back = m.decode(ids)
                    if digests:
                        spelled = " ".join(map(str, ids)).encode()
                        out.append((len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()))
                    else:
                        out.append((len(ids), ids, back))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
