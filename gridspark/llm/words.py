"""Words and hashes of whole Arrow string batches, without a Python loop over words.

A batch's UTF-8 buffer is cut into blocks of whole documents (about ``BLOCK_BYTES``), so the
working arrays stay small at any batch size.  Word and window hashes are 64-bit polynomials
over prefix sums, mixed; equal words give equal hashes in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93 | 1)
_U = np.uint64

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    if np.ndim(h) == 0:  # scalars would warn of the intended overflow
        return mixed(np.array([h], dtype=np.uint64))[0]
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = int(base), _inverse(int(base))
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 19)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM)


def _prefix(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    up, down = powers.get(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * up[:n], out=total[1:])
    return total, down


class Words(NamedTuple):
    """Words of a block of documents, in order."""

    data: np.ndarray  #: UTF-8 bytes of the block
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: per document, index of its first word; one more entry at the end
    low: int  #: the first document's row in the batch
    high: int  #: the row after the last document
    byte_first: np.ndarray  #: per document, its first byte; one more entry at the end

    def doc(self) -> np.ndarray:
        """The document (from 0 in this block) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(texts: pa.Array, is_space: np.ndarray = _IS_SPACE, lower: bool = False) -> Iterator[Words]:
    """Blocks of whole documents of a string array; nulls have no words.

    ``lower`` maps A-Z to lower case.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(content, dtype=np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), lengths, 0)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, side="right")) - 1
        high = min(max(high, low + 1), n)
        base = int(offsets[low])
        data = whole[base : int(offsets[high])]
        if lower:
            data = _LOWER[data]
        yield _words(data, offsets[low : high + 1] - base, lengths[low:high], low, high, is_space)
        low = high


def _words(data, doc_start, lengths, low, high, is_space) -> Words:
    n = len(data)
    solid = ~is_space[data]
    if n and (np.diff(doc_start) != lengths).any():  # bytes below a null
        for d in np.flatnonzero(np.diff(doc_start) != lengths):
            solid[doc_start[d] : doc_start[d + 1]] = False
    edge = np.ones(n + 1, dtype=bool)  # edge[i]: position i starts afresh
    if n:
        edge[1:n] = ~solid[: n - 1]
        edge[doc_start[:-1][doc_start[:-1] < n]] = True
    start = np.flatnonzero(solid & edge[:n])
    stop = np.ones(n + 1, dtype=bool)
    if n:
        stop[1:n] = ~solid[1:]
        stop[doc_start[:-1][doc_start[:-1] < n]] = True
    end = np.flatnonzero(solid & stop[1:]) + 1
    return Words(data, start, end, np.searchsorted(start, doc_start), low, high, doc_start)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash per word."""
    total, down = _prefix(w.data.astype(np.uint64) + _U(1), _BYTE_POWERS)
    size = (w.end - w.start).astype(np.uint64)
    return mixed((total[w.end] - total[w.start]) * down[w.start] + size * _U(0xA24BAED4963EE407))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive values; the last ``size - 1`` starts are absent."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    total, down = _prefix(h, _GRAM_POWERS)
    n = len(h) - size + 1
    return mixed((total[size:] - total[:n]) * down[:n])


def per_document(flags: np.ndarray, byte_first: np.ndarray) -> np.ndarray:
    """How many bytes of each document are flagged."""
    out = np.zeros(len(byte_first) - 1, dtype=np.int64)
    some = np.flatnonzero(np.diff(byte_first))
    if len(some):
        out[some] = np.add.reduceat(flags, byte_first[:-1][some], dtype=np.int64)
    return out


def inside(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """True where a window of ``size`` words starting there ends in the same document; ``n`` starts."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts)[:n] - np.arange(n)
    return left >= size


def covered(start: np.ndarray, size, n: int) -> np.ndarray:
    """True at each of ``n`` words that lies in a window of ``size`` words starting at ``start``."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + size, -1)
    return np.cumsum(steps[:n]) > 0


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of values from ``start`` to ``end``; agrees with ``window_hashes``."""
    total, down = _prefix(h, _GRAM_POWERS)
    return mixed((total[end] - total[start]) * down[start])


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``size`` words; a shorter document is one run of all its words."""
    h = word_hashes(w)
    windows = window_hashes(h, size)
    at = np.flatnonzero(inside(w.first, size, len(windows)))
    counts = w.count()
    short = np.flatnonzero((counts > 0) & (counts < size))
    doc = np.concatenate([w.doc()[at], short])
    return doc, np.concatenate([windows[at], span_hashes(h, w.first[:-1][short], w.first[1:][short])])


def bags(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) with their counts, documents in order."""
    joint = key ^ mixed(doc.astype(np.uint64) + _U(1))
    order = np.argsort(joint)
    sorted_ = joint[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(order)))
    first = order[head]
    back = np.argsort(doc[first], kind="stable")
    return doc[first][back], key[first][back], n[back]
