"""A compressed FM-index over integer texts in numpy: wavelet matrix over the Burrows-Wheeler transform, batched backward search.

Suffixes are sorted by their first DEPTH symbols, which is all that backward search of
patterns up to DEPTH needs: every pattern's suffixes are still one interval, and its counts are exact.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions sorted by the depth symbols (small non-negative integers) from each, by prefix doubling from as many as fit in 62 bits."""
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length()) if n else 1
    k = max(1, min(62 // bits, depth))
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        key[: n - i] += text[i:] + 1
    while True:
        order = np.argsort(key)  # equal keys keep no order: they are told apart below or not at all
        new = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        if k >= depth or new[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 2)
        key[: n - k] += rank[k:]
        k *= 2


class Bits:
    """Bit vector with rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols from 0; it is closed with a symbol of its own."""
        self.n = len(text) + 1
        closed = np.concatenate([np.asarray(text, np.int64) + 1, [0]])
        bwt = closed[suffix_order(closed) - 1]
        sigma = int(closed.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(closed, minlength=sigma))])
        self.levels: list[tuple[int, int, Bits]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift) & 1
            self.levels.append((shift, int(len(bwt) - bit.sum()), Bits(bit.astype(np.uint8))))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.start = np.zeros(sigma, np.int64)
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, zeros, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        c = symbol + 1
        both = self._descend(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.first[c] - self.start[c]
        return base + both[: len(c)], base + both[len(c) :]

    def count(self, pattern) -> int:
        lo, hi = np.array([0]), np.array([self.n])
        for c in reversed(list(pattern)):
            lo, hi = self.extend(np.array([c]), lo, hi)
        return int(hi[0] - lo[0])


def repeats(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(stream, start, stop): maximal steps of the streams text[begin:end] that the index holds twice or more, of at least least symbols (least < DEPTH).

    Every window of least symbols that occurs twice lies in a reported interval and none else does.
    Each stream is read backwards while its match occurs twice. Where that fails at a symbol, no window past the
    match's end holds that symbol; short probes of 2, 4, 8, ... symbols from it find how far on
    a match with it may end, and the search goes on from there.
    """
    out: list[tuple[int, int, int]] = []
    stream = np.flatnonzero(end - begin >= least)
    e = end[stream].copy()
    p = e.copy()
    lo, hi = np.zeros(len(e), np.int64), np.full(len(e), index.n)
    q, limit, g = np.full(len(e), -1), e.copy(), np.zeros(len(e), np.int64)
    while len(stream):
        b = begin[stream]
        new_lo, new_hi = index.extend(text[p - 1], lo, hi)
        twice = new_hi - new_lo >= 2
        ok = twice & (e - p < DEPTH - 1)
        p = np.where(ok, p - 1, p)
        lo, hi = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi)
        extending = q < 0
        at_start = ok & extending & (p == b)
        stopped = ~ok & extending
        for i in np.flatnonzero((at_start | stopped) & (e - p >= least)):
            out.append((int(stream[i]), int(p[i] - b[i]), int(e[i] - b[i])))
        deep = stopped & twice
        failed = stopped & ~twice
        longer = ok & ~extending & (p == q)
        unique = ~ok & ~extending
        limit = np.where(failed, e, limit)
        q = np.where(failed, p - 1, q)
        g = np.where(failed, 2, np.where(longer, g * 2, g))
        probe = failed | longer
        over = probe & (q + g >= limit)
        e = np.where(deep, p + least - 1, np.where(unique, e - 1, np.where(over, limit - 1, np.where(probe, q + g, e))))
        q = np.where(unique | over, -1, q)
        again = deep | unique | probe
        p = np.where(again, e, p)
        lo, hi = np.where(again, 0, lo), np.where(again, index.n, hi)
        keep = ~at_start & ((q >= 0) | (e - b >= least))
        stream, e, p, lo, hi, q, limit, g = (x[keep] for x in (stream, e, p, lo, hi, q, limit, g))
    return out
