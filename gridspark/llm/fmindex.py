"""An FM-index over words, searched for many queries at once.

The Burrows-Wheeler transform of the indexed words is kept as a wavelet matrix: per bit of the
word numbers one packed bit vector with counts per 64 bits.  Backward search extends all queries
of a batch by one word per step, in numpy.  Each text has an owner, and a table of minima over the
suffix order tells the least owner of any range, so a search can ask for matches in texts of
owners below a limit: the longer a match, the fewer its owners, so it ends where the limit does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gridspark.llm import words as W

_END, _GAP = 0, 1  #: the text's end, and what stands between texts; words are numbered from 2 on
_ONE = np.uint64(1)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``x``, whose last value is its only 0; by doubling."""
    n, k = len(x), 1
    order = np.argsort(x, kind="stable")
    rank = np.zeros(n, dtype=np.int64)
    rank[order[1:]] = np.cumsum(x[order[1:]] != x[order[:-1]])
    while rank[order[-1]] != n - 1:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_ = key[order]
        rank[order[0]] = 0
        rank[order[1:]] = np.cumsum(sorted_[1:] != sorted_[:-1])
        k *= 2
    return order


class _Bits:
    """A packed bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class _Minima:
    """Least values of ranges, from the minima of all ranges of a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, reach = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-reach], last[reach:]))
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in self.levels])])
        self.flat = np.concatenate(self.levels)
        self.levels = []

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each ``[low, high)``, none of them empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        at = self.start[level]
        return np.minimum(self.flat[at + low], self.flat[at + high - (1 << level)])


class FMIndex:
    def __init__(self, x: np.ndarray, symbols: int, owner: np.ndarray | None = None):
        """``x``: numbers below ``symbols``, ending with its only 0; ``owner``: whose word each is."""
        order = suffix_array(x)
        if owner is not None:
            self.names, rank = np.unique(owner, return_inverse=True)
            self.owners = _Minima(rank.astype(np.int32)[order])
        bwt = x[order - 1]
        self.n, self.symbols = len(x), symbols
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=symbols))])
        self.levels, self.zeros = [], []
        for bit in range(max(symbols - 1, 1).bit_length() - 1, -1, -1):
            ones = ((bwt >> bit) & 1).astype(bool)
            self.levels.append((bit, _Bits(ones)))
            self.zeros.append(int(len(bwt) - ones.sum()))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        every = np.arange(symbols)
        self.base = self._down(every, np.zeros(symbols, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bit, level), zeros in zip(self.levels, self.zeros):
            ones = level.rank(i)
            i = np.where((c >> bit) & 1, zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after a word is put before each match."""
        shift = self.first[c] - self.base[c]
        return self._down(c, low) + shift, self._down(c, high) + shift

    def _step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray | None):
        """Ranges after a word is put before each match, and whether any match within the limit is left."""
        known = c >= 0
        lo, hi = self.extend(np.where(known, c, 0), low, high)
        go = known & (lo < hi)
        if limit is not None and go.any():
            at = np.flatnonzero(go)
            go[at] = self.owners.of(lo[at], hi[at]) < limit[at]
        return lo, hi, go

    def possible(self, queries: np.ndarray, first: np.ndarray, size: int, limit: np.ndarray) -> np.ndarray:
        """Queries of which a window may match: those whose common words, where all its windows have some, do."""
        length = np.diff(first)
        q = np.flatnonzero(length >= size)
        at = np.where(length[q] < 2 * size, first[:-1][q] + size, first[:-1][q] + 1)
        floor = np.where(length[q] < 2 * size, first[1:][q] - size, at)
        low, high = np.zeros(len(q), np.int64), np.full(len(q), self.n)
        out = []
        while q.size:
            done = at <= floor
            out.append(q[done])
            q, at, floor, low, high = (x[~done] for x in (q, at, floor, low, high))
            lo, hi, go = self._step(queries[at - 1], low, high, limit[q])
            q, at, floor, low, high = (x[go] for x in (q, at - 1, floor, lo, hi))
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def intervals(self, queries: np.ndarray, first: np.ndarray, size: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, start, end) of stretches of ``size`` words or more whose every ``size`` words occur,
        with ``limit`` in a text of an owner below the query's.

        ``queries`` holds the queries' words one after another, -1 for words not indexed; query q
        is ``first[q]`` to ``first[q + 1]``.  Each search runs backward as far as it matches; where
        it stops at a word, the next one starts ``size`` words further on from that word, since no window
        between holds.
        """
        floor, end = first[:-1].copy(), first[1:].copy()
        if limit is not None:
            limit = np.searchsorted(self.names, limit)  # owners below it
        q = np.flatnonzero(end - floor >= size) if limit is None else self.possible(queries, first, size, limit)
        end = end[q]
        at, low, high = end.copy(), np.zeros(len(q), np.int64), np.full(len(q), self.n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while q.size:
            done = at <= floor[q]
            c = np.where(done, -1, queries[np.maximum(at - 1, 0)])
            lo, hi, go = self._step(c, low, high, None if limit is None else limit[q])
            stop = ~go
            if stop.any():
                hit = stop & (end - at >= size)
                found.append((q[hit], at[hit], end[hit]))
                # a word before `at` failed: the next window that can match starts there or lower
                more = stop & ~done
                # a failure inside the first `size` words says that the window ending at `end` is absent
                next_end = np.where(end - at >= size, at - 1 + size, end - 1)
                end = np.where(more, next_end, end)
                lo, hi = np.where(more, 0, lo), np.where(more, self.n, hi)
            at = np.where(go, at - 1, np.where(stop, end, at))
            keep = go | (stop & ~done & (end - floor[q] >= size))
            q, end, at, low, high = q[keep], end[keep], at[keep], lo[keep], hi[keep]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one array, and the first word of each text."""
    parts, counts = [], []
    for w in W.blocks(texts):
        sizes = np.concatenate([[0], np.cumsum(w.end - w.start)])
        picked = np.repeat(w.start - sizes[:-1], np.diff(sizes)) + np.arange(sizes[-1])
        parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(w.data[picked])]))
        counts.append(w.count())
    words = pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())
    return words, np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int64)


def index_of(texts: pa.Array, owner: np.ndarray | None = None) -> tuple[FMIndex, pa.Array]:
    """The index of the texts' words, and its words in order of their numbers."""
    words, first = _split(texts)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
    x = np.full(len(ids) + len(texts) + 1, _GAP, dtype=np.int64)
    x[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(first))] = ids
    x[-1] = _END
    whose = None
    if owner is not None:
        whose = np.append(np.repeat(owner, np.diff(first) + 1), np.iinfo(np.int64).max)  # a text's words and the gap behind it
    return FMIndex(x, len(coded.dictionary) + 2, whose), coded.dictionary


def search(index: FMIndex, vocabulary: pa.Array, texts: pa.Array, size: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last) of the matching stretches of each text, in texts of owners below its limit."""
    words, first = _split(texts)
    ids = pa.compute.fill_null(pa.compute.index_in(words, vocabulary), -3).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    q, start, end = index.intervals(np.append(ids, -1), first, size, limit)
    return q, start - first[q], end - first[q]
