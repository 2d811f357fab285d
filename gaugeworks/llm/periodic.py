"""Periodic runs of words by tandem repeats: Lempel-Ziv blocks give a leftmost covering set of squares, suffix-link walks the other ones, and their occurrences merge into runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, text_bytes, word_hashes

#: A run has so many words, and so many periods, at least.
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: So many words of a run at least come again a period later in it.
GRAM = MIN_LENGTH - MIN_LENGTH // MIN_EXPONENT
_STEP = 1 << 18


def repetitive(texts: list[bytes]) -> np.ndarray:
    """Which texts repeat GRAM words in a row; others can have no run. Words are compared by hash, so a collision can only keep a text."""
    grams, n = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), n)
    out = np.zeros(len(texts), bool)
    if len(grams) < GRAM:
        return out
    size = 1
    while size < GRAM:  # grams of a power of two, then the two that make up GRAM
        step = min(size, GRAM - size)
        grams = (grams[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ grams[:-step] >> np.uint64(29)) + grams[step:] * np.uint64(0xD6E8FEB86659FD93)
        size += step
    inside = of[: len(grams)] == of[GRAM - 1 :]
    of = of[: len(grams)][inside]
    keys = (grams[inside] ^ grams[inside] >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + of.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(keys)
    out[of[order[1:][keys[order[1:]] == keys[order[:-1]]]]] = True
    return out


class SuffixTree:
    """A sequence's suffix tree, held as its suffix array, the longest common prefixes of neighbours, and range minima over these; a locus is an interval of suffixes and a depth.

    Ranks of all stretches of 1, 2, 4, ... words (as far as any repeats) give common extensions in either direction: 4 bytes a word and level.
    """

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        rank = np.unique(words, return_inverse=True)[1]
        self.ranks, step = [], 1
        while True:
            self.ranks.append(np.append(rank, -1).astype(np.int32))
            if not n or rank.max() == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)[1]
            step *= 2
        self.rank = rank
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        self.lcp = np.zeros(n + 1, np.int32)  # with the suffix before; none before the first and after the last
        if n > 1:
            a, b = self.suffixes[:-1], self.suffixes[1:]
            self.lcp[1:n] = self.forward(np.minimum(a, b), np.maximum(a, b))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words alike from i < j <= n on."""
        return self._extend(i, j, lambda r, a, b, step: r[a] == r[b], 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words alike before i < j."""
        return self._extend(i, j, lambda r, a, b, step: (a >= step) & (r[np.maximum(a - step, 0)] == r[b - step]), -1)

    def _extend(self, i, j, same, sign):
        out = np.zeros(len(i), np.int64)
        for s in range(0, len(i), _STEP):
            a, b, total = i[s : s + _STEP].copy(), j[s : s + _STEP].copy(), out[s : s + _STEP]
            for level in range(len(self.ranks) - 2, -1, -1):
                step = (1 << level) * same(self.ranks[level], a, b, 1 << level)
                total += step
                a += sign * step
                b += sign * step
        return out

    def locus(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes, from lo to hi - 1, that begin like those at i to the given depth."""
        least = [self.lcp]
        while 2 << (len(least) - 1) <= self.n:
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        lo, hi = self.rank[i].astype(np.int64), self.rank[i].astype(np.int64) + 1
        for k in range(len(least) - 1, -1, -1):
            size, row = 1 << k, least[k]
            at = np.minimum(hi, len(row) - 1)
            hi = np.where((hi + size <= self.n) & (row[at] >= depth), hi + size, hi)
            at = np.maximum(lo - size + 1, 0)
            lo = np.where((lo >= size) & (row[np.minimum(at, len(row) - 1)] >= depth), lo - size, lo)
        return lo, hi

    def blocks(self) -> np.ndarray:
        """Borders of the Lempel-Ziv blocks: each is the longest stretch that begins earlier too, or one word."""
        n = self.n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank.tolist()
        near_left, near_right = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):  # suffixes leave from the last on, so that neighbours in order begin earlier
            r = rank[i]
            p, q = before[r], after[r]
            near_left[i], near_right[i] = p, q
            if p >= 0:
                after[p] = q
            if q < n:
                before[q] = p
        left, right = np.array(near_left), np.array(near_right)
        longest = np.zeros(n, np.int64)
        for near, has in ((left, left >= 0), (right, right < n)):
            here = np.flatnonzero(has)
            longest[here] = np.maximum(longest[here], self.forward(self.suffixes[near[here]], here))
        size, at, i = np.maximum(longest, 1).tolist(), [0], 0
        while i < n:
            i += size[i]
            at.append(i)
        return np.array(at)


def _ramps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row as many of it as its size says, and 0, 1, ... within it."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, period, more): squares so that each distinct square's leftmost occurrence is one of these or of the more ones right after it.

    Two sorts for each block and period: centres in the block whose square passes the block's end, and centres after the block's begin.
    """
    at = tree.blocks()
    size = np.diff(at)
    found = []
    rows, k = _ramps(size)
    end = at[1:][rows]
    found.append((end - k - 1, end, k + 1))
    rows, k = _ramps(size + np.append(size[1:], 0))
    begin = at[:-1][rows]
    inside = begin + k + 1 <= tree.n
    found.append((begin[inside], begin[inside] + k[inside] + 1, k[inside] + 1))
    i, j, k = (np.concatenate(x) for x in zip(*found))
    right, left = tree.forward(i, j), tree.backward(i, j)
    square = right + left >= k
    i, k, right, left = i[square], k[square], right[square], left[square]
    start = np.maximum(i - left, i - k)
    return start, k, np.minimum(i + right - k - start, k - 1)


_SMALLEST = np.zeros(2, np.int64)


def _smallest_factors(most: int) -> np.ndarray:
    """The smallest prime factor of 0, 1, ..., most."""
    global _SMALLEST
    if len(_SMALLEST) <= most:
        f = np.arange(max(most + 1, 1024))
        for p in range(2, int(len(f) ** 0.5) + 1):
            if f[p] == p:
                f[p * p :: p] = np.minimum(f[p * p :: p], p)
        _SMALLEST = f
    return _SMALLEST


def primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which squares' halves are no powers themselves: no k / prime is a period too."""
    factor = _smallest_factors(int(k.max(initial=1)))
    out, left = np.ones(len(k), bool), k.copy()
    while len(on := np.flatnonzero(out & (left > 1))):
        p = factor[left[on]]
        d = k[on] // p
        out[on] = tree.forward(start[on], start[on] + d) < 2 * k[on] - d
        left[on] //= p
    return out


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    if len(words) < 2:
        return []
    tree = SuffixTree(words)
    start, k, more = covering_squares(tree)
    keep = primitive(tree, start, k)
    start, k, more = start[keep], k[keep], more[keep]
    # A suffix link leads from a square's locus to that of the square a word later, if the square's first word comes next; after k steps it is the first one again.
    rows, step = _ramps(more + 1)
    start, k = start[rows] + step, k[rows]
    lo, hi = tree.locus(start, 2 * k)
    _, one = np.unique(lo * (tree.n + 1) + k, return_index=True)  # the vocabulary: distinct squares
    rows, step = _ramps((hi - lo)[one])
    place = np.sort(k[one][rows] * (tree.n + 1) + tree.suffixes[lo[one][rows] + step])
    first = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    k, begin = np.divmod(place[first], tree.n + 1)
    length = place[last] - place[first] + 2 * k
    on = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * k)
    return sorted(zip(begin[on].tolist(), length[on].tolist(), k[on].tolist()))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words left, joined by one space, when every run goes but for its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(w for w, gone in zip(words, (np.cumsum(change) > 0).tolist()) if not gone) if found else b" ".join(words)


def _found(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for b in pieces(batch, 1):
            texts = b.column(1).to_pylist()
            every, left, total = [], [], []
            for data, again in zip(texts, repetitive(texts).tolist()):
                words, found = data.split(), []
                if again:
                    number: dict[bytes, int] = {}
                    found = runs(np.array([number.setdefault(w, len(number)) for w in words]))
                every.append([{"start": s, "length": n, "period": k} for s, n, k in found])
                left.append(collapsed(words, found))
                total.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(every, kind), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs (doc_id, text).

    A run (start, length, period) is a stretch of words with that smallest period, of MIN_LENGTH words and MIN_EXPONENT periods at least, that cannot be
    longer; runs are sorted by start, then period, and may overlap. collapsed has the words in no run, or in the first period of each that holds them, joined by one space.
    A null text has no words. Repeated rows and rows without doc_id each get a row; other columns are not read; an empty table gives no rows.
    Texts do not move: each is worked on where it lies, in memory of some 4 bytes a word and level of its longest repeat, and time that grows by that logarithm too.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("data")).mapInArrow(_found, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def best_run(found: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(found, none, lambda a, x: F.when(better(a, x), x).otherwise(a))
