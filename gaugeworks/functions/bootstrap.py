"""Bootstrap errors: every row has Poisson(1) weights drawn by hash, one a replicate, and replicates are sums of weighted statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, translation

#: Metrics over whole texts are costly to repeat: so many replicates at most.
TEXT_REPLICATES = 100
#: Bytes of sums that a task holds before it hands them on, and weights worked out at once.
HELD, AT_ONCE = 64 << 20, 1 << 22
_LOW = np.uint64(0xFFFFFFFF)


def poisson_steps(most: int = 12) -> list[int]:
    """A 32-bit number has weight k if k of these are no larger: the distribution function of Poisson(1), times 2^32."""
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(most):
        total += p
        steps.append(int(total * 2**32))
        p /= k + 1
    return steps


#: Multipliers of a published 32-bit mixer (three shifts, two products), and the golden ratio's bits that set replicates apart.
MIX_1, MIX_2, APART = 0x7FEB352D, 0x846CA68B, 0x9E3779B9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = ((x ^ x >> np.uint64(16)) * np.uint64(MIX_1)) & _LOW
    x = ((x ^ x >> np.uint64(15)) * np.uint64(MIX_2)) & _LOW
    return x ^ x >> np.uint64(16)


def weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A row of Poisson(1) weights for each id, the same wherever and in whatever order it is met."""
    ids = ids.astype(np.uint64)
    row = _mixed(((ids ^ ids >> np.uint64(32)) & _LOW) ^ np.uint64(seed))
    drawn = _mixed(row[:, None] + np.arange(replicates, dtype=np.uint64) * np.uint64(APART) & _LOW)
    return np.searchsorted(np.array(poisson_steps(), np.uint64), drawn, side="right").astype(np.float64)


def replicate_sums(df: DataFrame, keys: list[str], stats: list[str], replicates: int, seed: int = 1234, doc: str = "doc_id") -> DataFrame:
    """(keys, b, stats): for each key and replicate the sums of the statistics, each row weighted by its draw.

    Rows stay in their tasks, where a matrix product of weights and statistics adds up all replicates; a task hands on one array a key, and only these
    arrays are shuffled and summed, by key and replicate. Rows of equal doc share their weights.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ids = F.col(doc).cast("long") if kinds[doc] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(doc)
    wide = df.select(*keys, F.coalesce(ids, F.lit(0)).alias("__id"), *[F.col(s).cast("double").alias(s) for s in stats])

    def partial(batches):
        import pyarrow as pa

        held: dict[tuple, np.ndarray] = {}

        def out():
            columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(keys))]
            sums = pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*columns, sums], [*keys, "__sums"])

        schema = None
        for batch in batches:
            schema = batch.schema
            number: dict[tuple, int] = {}
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))) if keys else [()] * batch.num_rows
            code = np.fromiter((number.setdefault(k, len(number)) for k in rows), np.int64, len(rows))
            order = np.argsort(code, kind="stable")
            id_of = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            table = np.column_stack([batch.column(len(keys) + 1 + j).to_numpy(zero_copy_only=False) for j in range(len(stats))])
            ends = np.cumsum(np.bincount(code, minlength=len(number)))
            for k, end, size in zip(number, ends.tolist(), np.diff(ends, prepend=0).tolist()):
                total = held.setdefault(k, np.zeros((replicates, len(stats))))
                for a in range(end - size, end, max(1, AT_ONCE // replicates)):
                    at = order[a : min(end, a + max(1, AT_ONCE // replicates))]
                    total += weights(id_of[at], replicates, seed).T @ table[at]
                if len(held) * replicates * len(stats) * 8 > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    shape = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["__sums array<double>"])
    each = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: F.struct(b.alias("b"), *[F.get("__sums", b * len(stats) + j).alias(s) for j, s in enumerate(stats)]))
    return wide.mapInArrow(partial, shape).select(*keys, F.inline(each)).groupBy(*keys, "b").agg(*[F.sum(s).alias(s) for s in stats])


def _spread(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.stddev_samp("m").alias("stderr"))


def bootstrap_stderr(df: DataFrame, keys: list[str], replicates: int = 1000, seed: int = 1234, v: str = "v", doc: str = "doc_id", of: str = "mean") -> DataFrame:
    """(keys, stderr): spread of a statistic of v over replicates. of: mean, nanmean, perplexity or median. A replicate without any row counts for none."""
    rows = df.where(F.col(v).isNotNull())
    if of == "nanmean":
        rows = rows.where(~F.isnan(v))
    if of == "median":
        return _spread(metrics.replicate_medians(rows.select(*keys, F.col(doc).alias("doc_id"), F.col(v).alias("v")), keys, replicates, seed), keys)
    sums = replicate_sums(rows.select(*keys, doc, F.col(v).alias("v"), F.lit(1.0).alias("n")), keys, ["v", "n"], replicates, seed, doc)
    mean = F.try_divide("v", "n")
    return _spread(sums.select(*keys, {"mean": mean, "nanmean": mean, "perplexity": F.exp(-mean)}[of].alias("m")), keys)


def bootstrap_pairs(df: DataFrame, keys: list[str], of: str, replicates: int = 1000, seed: int = 1234, doc: str = "doc_id", positive: int | str = "1") -> DataFrame:
    """(keys, stderr) of a metric over all (gold, pred) pairs: f1, macro_f1, weighted_f1, micro_f1, mcc, bleu, chrf or ter; the last three repeat TEXT_REPLICATES times at most.

    Label metrics need the counts of each pair of labels only, so these are the sums; text metrics the counts of each text, worked out once a row.
    """
    if of in ("f1", "macro_f1", "weighted_f1", "micro_f1", "mcc"):
        cells = replicate_sums(df.select(*keys, "gold", "pred", doc, F.lit(1.0).alias("n")), [*keys, "gold", "pred"], ["n"], replicates, seed, doc).where("n > 0")
        if of == "f1":
            g, p = F.col("gold") == positive, F.col("pred") == positive
            tp, wrong = F.sum(F.when(g & p, F.col("n")).otherwise(0.0)), F.sum(F.when(g != p, F.col("n")).otherwise(0.0))
            return _spread(cells.groupBy(*keys, "b").agg(F.coalesce(F.try_divide(2 * tp, 2 * tp + wrong), F.lit(0.0)).alias("m")), keys)
        return _spread(metrics.classification(cells, [*keys, "b"], weight="n").select(*keys, F.col(of).alias("m")), keys)
    counts, score = {"bleu": (translation.bleu_counts, translation.bleu_score), "chrf": (translation.chrf_counts, translation.chrf_score), "ter": (translation.ter_counts, translation.ter_score)}[of]
    rows = counts(df.select(*keys, doc, "pred", F.col("gold").alias("ref")), [*keys, doc])
    stats = [c for c in rows.columns if c not in (*keys, doc)]
    sums = replicate_sums(rows, keys, stats, min(replicates, TEXT_REPLICATES), seed, doc)
    return _spread(sums.select(*keys, score().alias("m")), keys)
