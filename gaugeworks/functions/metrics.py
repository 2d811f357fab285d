"""Per-document scores and aggregations over long metric tables. Aggregations are expressions over (doc_id, v, w, gold, pred, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordering import kth


def argmax(values: Column) -> Column:
    """Position of the largest, the first of equals; NaN counts as largest, as in numpy."""
    ranked = F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i")))
    return -F.array_max(ranked)["i"]


def acc(lls: Column, gold: Column) -> Column:
    return (argmax(lls) == gold).cast("double")


def acc_norm(lls: Column, choices: Column, gold: Column) -> Column:
    """By characters of the choice."""
    return acc(F.zip_with(lls, choices, lambda l, c: l / F.length(c)), gold)


def acc_bytes(lls: Column, choices: Column, gold: Column) -> Column:
    return acc(F.zip_with(lls, choices, lambda l, c: l / F.octet_length(c)), gold)


def acc_mutual_info(lls: Column, unconditional: Column, gold: Column) -> Column:
    return acc(F.zip_with(lls, unconditional, lambda a, b: a - b), gold)


def acc_any(lls: Column, golds: Column) -> Column:
    return F.array_contains(golds, argmax(lls)).cast("double")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def brier(probs: Column, gold: Column) -> Column:
    return F.aggregate(F.transform(probs, lambda p, i: F.pow(p - (i == gold).cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def mc2(lls: Column, labels: Column) -> Column:
    """Normalised probability of the choices labelled 1."""
    return F.aggregate(F.zip_with(softmax(lls), labels, lambda p, l: p * l), F.lit(0.0), lambda s, x: s + x)


def gold_rank(lls: Column, gold: Column) -> Column:
    """1 if no choice beats gold; equal ones before it count as better."""
    return 1 + F.size(F.filter(F.transform(lls, lambda v, i: (v > F.get(lls, gold)) | ((v == F.get(lls, gold)) & (i < gold))), lambda b: b))


# --- aggregations: name -> (expression over v, w; has a closed-form error; higher is better)
def nanmean(v: Column = None) -> Column:
    v = F.col("v") if v is None else v
    return F.coalesce(F.avg(F.when(~F.isnan(v), v)), F.lit(float("nan")))


def median(df: DataFrame, keys: list[str], v: str = "v", order: str = "doc_id") -> DataFrame:
    """(keys, value, n): the value at place n // 2 in order of arrival; values aren't sorted. No group is gathered."""
    return kth(df, keys, order, F.expr("n div 2"), [v]).select(*keys, F.col(v).alias("value"), "n")


def replicate_medians(df: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """(keys, b, m): the positional median of each replicate, of rows (doc_id, v) with Poisson weights, found by ranges of doc_id.

    A pass sums the weights of all replicates by range; only ranges that hold a replicate's middle are looked into again, until a range is one doc_id.
    """
    from .bootstrap import replicate_sums

    doc = F.col("doc_id")
    rows = df if dict(df.dtypes)["doc_id"] in ("bigint", "int", "double") else df.withColumn("doc_id", F.xxhash64("doc_id"))
    whole = rows.groupBy(*keys).agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"))
    todo = rows.join(whole, keys)
    spot, found = None, None
    while True:
        at = F.coalesce(F.width_bucket(doc.cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double"), F.lit(MEDIAN_RANGES)), F.lit(0))
        todo = todo.withColumn("range", at)
        sums = replicate_sums(todo.select(*keys, "lo", "range", "doc_id", F.lit(1.0).alias("k")), [*keys, "lo", "range"], ["k"], replicates, seed).where("k > 0")
        one = Window.partitionBy(*keys, "lo", "b")
        if spot is None:
            upto = sums.withColumn("upto", F.sum("k").over(one.orderBy("range"))).withColumn("rest", F.floor(F.sum("k").over(one) / 2))
        else:
            upto = sums.join(spot, [*keys, "lo", "b"]).withColumn("upto", F.sum("k").over(one.orderBy("range")))
        spot = upto.where("rest < upto AND rest >= upto - k").select(*keys, "lo", "range", "b", (F.col("rest") - F.col("upto") + F.col("k")).alias("rest"))
        bounds = todo.groupBy(*keys, "lo", "range").agg(F.min(doc).alias("low"), F.max(doc).alias("high"), F.min("v").alias("v"))
        spot = written(spot.join(bounds, [*keys, "lo", "range"]), "median-spot")
        done = spot.where("low = high").select(*keys, "b", F.col("v").alias("m"))
        found = done if found is None else found.unionByName(done)
        if spot.where("low < high").isEmpty():
            return found
        narrower = spot.where("low < high").select(*keys, "lo", "range", "low", "high").distinct()
        todo = written(todo.drop("hi").join(narrower, [*keys, "lo", "range"]).select(*keys, "doc_id", "v", F.col("low").alias("lo"), F.col("high").alias("hi")), "median-rows")
        spot = spot.where("low < high").select(*keys, F.col("low").alias("lo"), "b", "rest")


def perplexity(v: str = "v") -> Column:
    return F.exp(-F.avg(v))


def weighted_perplexity(v: str = "v", w: str = "w") -> Column:
    return F.exp(-F.sum(v) / F.sum(w))


def bits_per_byte(v: str = "v", w: str = "w") -> Column:
    return -F.sum(v) / F.sum(w) / F.log(F.lit(2.0))


AGGREGATIONS = {"mean": lambda: F.avg("v"), "nanmean": nanmean, "perplexity": perplexity, "weighted_perplexity": weighted_perplexity, "bits_per_byte": bits_per_byte, "bypass": lambda: F.lit(999.0)}



def register(name: str, aggregation: Callable[[], Column], higher_is_better: bool = True) -> None:
    """Add an aggregation over v and w under a name of its own; a name that is taken is an error. Without a known error it has none."""
    if name in AGGREGATIONS:
        raise ValueError(f"there is an aggregation {name!r}")
    AGGREGATIONS[name] = aggregation
    if not higher_is_better:
        LOWER_IS_BETTER.add(name)


LOWER_IS_BETTER = {"perplexity", "word_perplexity", "byte_perplexity", "bits_per_byte", "brier_score", "ter"}
CLOSED_FORM_ERROR = {"mean", "acc_all"}
BOOTSTRAPPED = {"median", "perplexity", "nanmean"}
BOOTSTRAPPED_PAIRS = {"mcc", "f1", "bleu", "chrf", "ter"}
#: Ranges of a pass over replicates' medians.
MEDIAN_RANGES = 64


def stderr(v: str = "v") -> Column:
    """Standard error of the mean; null for one value."""
    return F.stddev_samp(v) / F.sqrt(F.count(v))


def f1_binary(gold: str = "gold", pred: str = "pred", positive: int | str = 1) -> Column:
    g, p = F.col(gold) == positive, F.col(pred) == positive
    tp, wrong = F.count_if(g & p), F.count_if(g != p)
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0))


def per_class(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """(keys, label, tp, n_gold, n_pred, f1): a confusion row for each label seen as gold or prediction; a row counts as often as its weight says."""
    w = F.lit(1) if weight is None else F.col(weight)
    both = df.select(*keys, F.inline(F.array(F.struct(F.col(gold).alias("label"), w.alias("g"), (w * 0).alias("p")), F.struct(F.col(pred).alias("label"), (w * 0).alias("g"), w.alias("p")))), (F.col(gold) == F.col(pred)).alias("hit"))
    n = both.groupBy(*keys, "label").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("g"))), F.lit(0)).alias("tp"))
    return n.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_gold") + F.col("n_pred")), F.lit(0.0)))


def classification(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """(keys, macro_f1, weighted_f1, micro_f1, mcc) from confusion counts."""
    tk, pk, c, s = F.col("n_gold"), F.col("n_pred"), F.sum("tp"), F.sum("n_gold")
    cov = c * s - F.sum(tk * pk)
    spread = F.sqrt((s * s - F.sum(pk * pk)) * 1.0) * F.sqrt((s * s - F.sum(tk * tk)) * 1.0)
    return per_class(df, keys, gold, pred, weight).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * tk) / s).alias("weighted_f1"), (c / s).alias("micro_f1"), F.coalesce(F.try_divide(cov * 1.0, spread), F.lit(0.0)).alias("mcc"))


def acc_all(df: DataFrame, keys: list[str], group: list[str], correct: str = "correct") -> DataFrame:
    """Share of groups with every answer right."""
    return df.groupBy(*keys, *group).agg(F.bool_and(correct).cast("double").alias("v")).groupBy(*keys).agg(F.avg("v").alias("acc_all"), stderr().alias("acc_all_stderr"))


def consistency(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Equal pairs of answers over all pairs, per key, from counts: no pair is written out."""
    n = df.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("n") * (F.col("n") - 1)) * 1.0, F.sum("n") * (F.sum("n") - 1)), F.lit(1.0)).alias("consistency"))
