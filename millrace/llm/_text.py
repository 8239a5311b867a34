"""Vectorised word hashing over batches of texts, for use inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
#: A random odd 64-bit value per byte and per position in a word.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POSITION = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes that belong to words: ASCII letters and digits, and every byte of a multi-byte character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
WORD_BYTE[128:] = True

#: Texts are handled in groups of about so many bytes, which bounds the arrays' memory.
GROUP_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in such a way that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts: lower-cased, in document order.

    buf: bytes of all texts, each followed by a space; start, stop: of each word in buf;
    doc: index of the text that each word is in; n: number of texts.
    """

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower().encode("utf-8", "ignore") for t in texts]
        self.n = len(texts)
        self.buf = np.frombuffer(b" " + b" ".join(lowered) + b" ", np.uint8)
        inside = WORD_BYTE[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.stop = edge[::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in lowered]) + 1 if lowered else np.zeros(0, int)
        self.doc = np.searchsorted(ends, self.start, side="right")

    def hashes(self, prefixes: tuple[int, ...] = ()) -> np.ndarray:
        """A row for each word: 64-bit hashes of the word and of its prefixes of so many bytes (0: no longer than that)."""
        if not len(self.start):
            return np.zeros((0, 1 + len(prefixes)), np.uint64)
        length = self.stop - self.start
        first = np.repeat(self.start - (np.cumsum(length) - length), length)
        at = np.arange(int(length.sum())) + first
        inner = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        values = _BYTE[self.buf[at]] * _POSITION[inner & 63]
        begin = np.cumsum(length) - length
        total = np.cumsum(values)
        before = total[begin] - values[begin]
        out = np.zeros((len(length), 1 + len(prefixes)), np.uint64)
        out[:, 0] = mix(total[begin + length - 1] - before)
        for k, n in enumerate(prefixes, 1):
            longer = length > n
            out[longer, k] = mix(total[begin[longer] + n - 1] - before[longer] + np.uint64(n))
        return out

    def first_of_doc(self) -> np.ndarray:
        """Index of the first word of each text; len n + 1."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES characters each; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > GROUP_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
