"""Errors and comparisons of results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pooled_stderr(se: str = "stderr", n: str = "n") -> Column:
    """Error of the pooled sample from subtask errors and sizes."""
    e, k = F.col(se), F.col(n)
    return F.sqrt(F.sum((k - 1) * e * e * k) / (F.sum(k) - F.count(k)) / F.sum(k))


def weighted_mean(v: str = "value", n: str = "n", by_size: bool = True) -> Column:
    return F.sum(F.col(v) * F.col(n)) / F.sum(n) if by_size else F.avg(v)


def compare(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, value_a, value_b, delta, z, p): two-sided z-test of two result tables (value, stderr)."""

    @F.pandas_udf("double")
    def tail(z):
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    x = a.select(*on, F.col("value").alias("value_a"), F.col("stderr").alias("sa")).join(b.select(*on, F.col("value").alias("value_b"), F.col("stderr").alias("sb")), on)
    z = F.try_divide(F.col("value_a") - F.col("value_b"), F.sqrt(F.col("sa") ** 2 + F.col("sb") ** 2))
    return x.select(*on, "value_a", "value_b", (F.col("value_a") - F.col("value_b")).alias("delta"), z.alias("z"), tail(z).alias("p"))
