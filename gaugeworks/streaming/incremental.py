"""Incremental scoring: sufficient statistics of a stream of scores, kept exact across micro-batches and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_results(scores: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """(keys, value, stderr, n) of a batch or streaming frame; state is three sums a key."""
    n, s, q = F.count(v), F.sum(v), F.sum(F.col(v) * F.col(v))
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
    return scores.groupBy(*keys).agg((s / n).alias("value"), F.sqrt(variance / n).alias("stderr"), n.alias("n"))


def windowed_results(scores: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes", v: str = "v") -> DataFrame:
    """As running_results, by event-time windows that close behind the watermark."""
    return running_results(scores.withWatermark(time, late).withColumn("window", F.window(time, width)), ["window", *keys], v)


def sink(results_path: str):
    """A foreachBatch writer: each micro-batch has its own folder, so a replayed one overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results_path}/epoch={epoch}")

    return write
