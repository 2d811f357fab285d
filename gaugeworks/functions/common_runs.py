"""The longest run of tokens that two answers share, by suffix automata on Arrow batches; tokens of mixed Han and alphabetic text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, words


def mixed_tokens(c: Column, marks: str = r"\p{P}") -> Column:
    """Each Han character (of the main block) and each mark alone, all else by blanks."""
    return words(F.regexp_replace(c, f"([一-龥]|{marks})", " $1 "))


class Automaton:
    """The suffix automaton of a sequence: its paths from the first state are just the sequence's runs."""

    def __init__(self, tokens: list):
        self.next: list[dict] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for t in tokens:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][t]
                if self.length[q] != self.length[p] + 1:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[new] = q
            last = new

    def longest(self, tokens: list) -> int:
        """Length of the longest run of tokens that is one of the sequence's, in one pass."""
        state, here, best = 0, 0, 0
        for t in tokens:
            while state and t not in self.next[state]:
                state = self.link[state]
                here = self.length[state]
            if t in self.next[state]:
                state, here = self.next[state][t], here + 1
            best = max(best, here)
        return best


def longest_common_run(a: Column, b: Column) -> Column:
    """Tokens of the longest run that two arrays share, 0 for null ones; time grows with both lengths, whatever they share."""

    @F.arrow_udf("long")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([Automaton(x).longest(y) if x and y else 0 for x, y in zip(xs.to_pylist(), ys.to_pylist())], pa.int64())

    return run(a, b)


def common_run_f1(prediction: Column, gold: Column) -> Column:
    """F1 of two token arrays whose overlap is their longest common run; 0 without one."""
    share = lambda n: F.coalesce(F.try_divide(2.0 * n, F.size(prediction) + F.size(gold)), F.lit(0.0))
    return F.when(prediction.isNotNull() & gold.isNotNull(), let(longest_common_run(prediction, gold), share)).otherwise(F.lit(0.0))
