"""Similarity of code lines by edits that only insert and delete."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import common_length



def indel_ratio(a: Column, b: Column) -> Column:
    """1 - edits / characters of both, in whole hundredths, 0 if either is empty or null; by code points."""

    @F.arrow_udf("double")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        each = ((x or "", y or "") for x, y in zip(xs.to_pylist(), ys.to_pylist()))
        return pa.array([round(200 * common_length(x, y) / (len(x) + len(y))) / 100 if x and y else 0.0 for x, y in each], pa.float64())

    return run(a, b)


def first_code_line(text: Column) -> Column:
    """The first line without a backquote, # or //; empty if there is none. Line feeds at the start don't count."""
    lines = F.split(F.regexp_replace(text, r"\A\n+", ""), "\n", -1)
    return F.coalesce(F.get(F.filter(lines, lambda x: ~F.regexp_like(x, F.lit("[`#]|//"))), 0), F.lit(""))


def code_similarity(prediction: Column, golds: Column) -> Column:
    """The best ratio of the prediction's first code line to one of the golds (an array); 0 without golds."""
    return line_similarity(first_code_line(prediction), golds)


def _ratio(x: str, y: str, common: int) -> float:
    return round(200 * common / (len(x) + len(y))) / 100


def best_ratio(x: str, golds: list[str]) -> float:
    """The best ratio of x to a gold; one whose length alone keeps it from more than the best so far is not looked into."""
    best = 0.0
    for y in sorted((y for y in golds or () if x and y), key=lambda y: abs(len(x) - len(y)) / (len(x) + len(y))):
        if _ratio(x, y, min(len(x), len(y))) <= best:
            break
        best = max(best, _ratio(x, y, common_length(x, y)))
    return best


def line_similarity(line: Column, golds: Column) -> Column:
    """The best ratio of a line to one of the golds (an array); 0 without golds."""

    @F.arrow_udf("double")
    def run(lines: pa.Array, every: pa.Array) -> pa.Array:
        return pa.array([best_ratio(x, ys) for x, ys in zip(lines.to_pylist(), every.to_pylist())], pa.float64())

    return run(line, golds)
