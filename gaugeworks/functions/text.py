"""Text expressions on columns, with Python's notion of blanks where the answer hangs on it."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, and Python's blanks as a Java pattern.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANK = r"(?U)[\s\x1c-\x1f]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body of value, worked out once a row: inside a lambda Spark would work a plain expression out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """str.strip()"""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def words(c: Column) -> Column:
    """str.split(): no empty words at the ends."""
    return F.filter(F.split(c, BLANK + "+"), lambda w: w != "")


def normalize(c: Column) -> Column:
    """ASCII letters lowered, ASCII punctuation deleted; other letters stay."""
    return F.translate(c, UPPER + PUNCTUATION, LOWER)


def normalize_all(c: Column) -> Column:
    """As normalize(), but letters of all alphabets are lowered, each by itself: lower() alone makes two characters of \u0130 and another small sigma at a word's end."""
    return F.lower(F.translate(c, "\u0130\u03a3" + PUNCTUATION, "i\u03c3"))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces; none if there are fewer tokens."""

    def of(t):
        # slice() copies the whole array each time; single elements are read in place
        many = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) >= n, many).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def answer_normal(c: Column) -> Column:
    """Extractive-QA normal form: lower, no ASCII punctuation, no English articles, single blanks."""
    bare = F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(words(bare), " ")


def exact_match(prediction: Column, reference: Column, ignore: list[str] = (), ignore_case: bool = False, ignore_punctuation: bool = False, ignore_numbers: bool = False) -> Column:
    """1.0 if both are equal after, in this order: patterns out, lower case, punctuation out, digits out."""

    def form(c: Column) -> Column:
        c = reduce(lambda x, p: F.regexp_replace(x, p, ""), ignore, c)
        c = F.lower(c) if ignore_case else c
        c = F.translate(c, PUNCTUATION, "") if ignore_punctuation else c
        return F.translate(c, "0123456789", "") if ignore_numbers else c

    return (form(prediction) == form(reference)).cast("double")


def _overlap(a: Column, b: Column) -> Column:
    count = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the two word multisets; 0 if they share none (also if both are empty)."""

    def of(a, b):
        f1 = lambda same: F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(a) + F.size(b)))
        return let(_overlap(a, b), f1)

    return let(prediction, lambda a: let(reference, lambda b: of(a, b)))


def best_of(golds: Column, score) -> Column:
    """Largest score over an array of golds."""
    return F.array_max(F.transform(golds, score))


def leave_one_out_best(golds: Column, score) -> Column:
    """Mean over golds of the best score among the others; the plain score if there is one gold."""

    def of(s):  # every gold is scored once
        each = F.transform(s, lambda _, i: F.array_max(F.filter(s, lambda x, j: j != i)))
        mean = F.aggregate(each, F.lit(0.0), lambda t, x: t + x) / F.size(s)
        return F.when(F.size(s) > 1, mean).otherwise(F.array_max(s))

    return let(F.transform(golds, score), of)


def truncate_at(c: Column, stops: list[str]) -> Column:
    """Cut at the first of each stop string in turn; empty stops are passed over."""
    return reduce(lambda x, s: F.substring_index(x, s, 1), [s for s in stops if s], c)


def after_thinking(c: Column, token: str) -> Column:
    """What follows the last token, without blanks at its start."""
    return F.regexp_replace(F.substring_index(c, token, -1), r"(?U)\A[\s\x1c-\x1f]+", "")


def contains_all_share(prediction: Column, references: Column) -> Column:
    """Share of the references found in the prediction, whatever their case."""
    hits = F.size(F.filter(references, lambda r: F.contains(F.lower(prediction), F.lower(r))))
    return hits / F.size(references)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets given as arrays; 1 if both are empty."""
    same = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(2.0 * same / total)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of two word arrays."""

    @F.pandas_udf("double")
    def run(ps, rs):
        import pandas as pd

        return pd.Series([_lcs_f1(list(p), list(r)) for p, r in zip(ps, rs)])

    return run(prediction, reference)


def common_length(a, b) -> int:
    """Length of the longest common subsequence of two texts or lists, by bits: a token's places in the shorter one are a number, and one addition moves a whole row of the table on."""
    a, b = sorted((a, b), key=len)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for i, w in enumerate(b):
        if m := at.get(w):
            hit = row & m
            row = row + hit | row - hit
            if not i & 255:  # what carries beyond the row does not come back
                row &= full
    return len(a) - (row & full).bit_count()


def _lcs_f1(a: list[str], b: list[str]) -> float:
    same = common_length(a, b)
    return 2.0 * same / (len(a) + len(b)) if same else 0.0


def _lcs_places(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence; among equally long ones that which steps back in a first."""
    table = [[0] * (len(b) + 1)]
    for x in a:
        above, row = table[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        table.append(row)
    i, j, found = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def _lsum_f1(prediction: list[list[str]], reference: list[list[str]]) -> float:
    left, wanted = (Counter(w for line in side for w in line) for side in (prediction, reference))
    total = left.total() + wanted.total()
    hits = 0
    for line in reference:
        for i in sorted(set().union(*(_lcs_places(line, p) for p in prediction))):
            w = line[i]
            if left[w] > 0 and wanted[w] > 0:
                hits, left[w], wanted[w] = hits + 1, left[w] - 1, wanted[w] - 1
    return 2.0 * hits / total if hits else 0.0


def rouge_lsum(prediction: Column, reference: Column) -> Column:
    """Summary-level ROUGE-L F1 of two texts: for each line of the reference the union of its longest common subsequences with all lines of the prediction, each word counted as often as both texts hold it. Words are runs of ASCII letters and digits in lower case."""

    @F.pandas_udf("double")
    def run(ps, rs):
        import pandas as pd

        lines = lambda t: [re.findall(r"[a-z0-9]+", x) for x in (t or "").lower().split("\n")]
        return pd.Series([_lsum_f1(lines(p), lines(r)) for p, r in zip(ps, rs)])

    return run(prediction, reference)
