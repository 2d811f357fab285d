"""Declarative tasks, a scorer protocol, and the plan from documents to task and group results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import translation
from ..functions.bootstrap import bootstrap_pairs, bootstrap_stderr
from ..functions.filters import apply_chains
from ..functions.stats import pooled_stderr, weighted_mean
from ..functions.text import words
from ..operators.requests import disjoint, multiple_choice, regroup, repeated, rolling_windows
from ..sources.scratch import written


class Scorer(Protocol):
    """Model boundary: adds ll and is_greedy, or text, to Arrow-batched request frames."""

    def __call__(self, batches: Iterator) -> Iterator: ...


@dataclass(frozen=True)
class Metric:
    name: str
    score: Callable[[], Column]  # over a document's columns
    aggregation: str = "mean"
    higher_is_better: bool = True
    weight: Callable[[], Column] | None = None  # what weighted_perplexity and bits_per_byte divide by: words or bytes
    gold: Callable[[], Column] | None = None  # of metrics over all pairs of a task: f1, mcc, bleu, chrf, ter, ...
    pred: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Task:
    name: str
    docs: DataFrame
    output_type: str  # multiple_choice, loglikelihood, loglikelihood_rolling or generate_until
    context: Column
    target: Column
    metrics: list[Metric]
    choices: Column | None = None
    filters: dict[str, list] = field(default_factory=lambda: {"none": [("take_first", {})]})
    repeats: int = 1
    tokens: Callable[[Column], Column] = words  # of rolling windows, with their length and context
    max_len: int = 2048
    context_len: int = 1
    prefix: str = "<|endoftext|>"
    unconditional: bool = False  # ask each choice without its context too, for acc_mutual_info
    process: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Aggregate:
    """A metric of a group: of which filters, and whether members count by their size or alike."""

    metric: str
    filters: tuple[str, ...] = ("none",)
    weight_by_size: bool = True


@dataclass(frozen=True)
class Group:
    name: str
    members: tuple[str, ...]
    metric: str = "acc"
    filters: tuple[str, ...] = ("none",)
    weight_by_size: bool = True
    aggregates: tuple[Aggregate, ...] = ()  # several metrics, in place of the one above

    @property
    def rolled_up(self) -> tuple[Aggregate, ...]:
        return self.aggregates or (Aggregate(self.metric, self.filters, self.weight_by_size),)


def with_options(tasks: list[Task], predict_only: bool = False, **changes) -> list[Task]:
    """The tasks with some of their fields changed, such as repeats, filters or max_len; predict_only asks the model and scores nothing."""
    if predict_only:
        changes["metrics"] = [Metric("bypass", lambda: F.lit(None), "bypass")]
    return [replace(t, **changes) for t in tasks]


def requests(task: Task) -> DataFrame:
    """(doc_id, idx, context, continuation, rep, req_hash). Choices asked without context follow the others: idx then begins at the number of choices. Rolling texts are asked by disjoint windows."""
    docs = task.process(task.docs) if task.process else task.docs
    if task.output_type == "multiple_choice":
        out = multiple_choice(docs, task.context, task.choices)
        if task.unconditional:
            bare = multiple_choice(docs, F.lit(""), F.transform(task.choices, lambda c: c)).join(docs.select("doc_id", F.size(task.choices).alias("k")), "doc_id")
            out = out.unionByName(bare.withColumn("idx", F.col("idx") + F.col("k")).drop("k"))
    elif task.output_type == "loglikelihood_rolling":
        windows = F.transform(rolling_windows(task.tokens(task.target), F.lit(task.prefix), task.max_len, task.context_len), disjoint)
        out = docs.select("doc_id", F.posexplode(windows).alias("idx", "x")).select("doc_id", "idx", F.array_join("x.input", " ").alias("context"), F.array_join("x.predicted", " ").alias("continuation"))
    else:
        continuation = task.target if task.output_type == "loglikelihood" else F.lit("")
        out = docs.select("doc_id", F.lit(0).alias("idx"), task.context.alias("context"), continuation.alias("continuation"))
    out = repeated(out, task.repeats)
    return out.withColumn("req_hash", F.sha2(F.to_json(F.struct(F.lit(task.output_type), "context", "continuation")), 256))


def cached_or_scored(asked: DataFrame, scorer, cache: DataFrame | None = None) -> DataFrame:
    """Responses from the cache where it has the request and repeat, else from the scorer; only the rest reaches the model. A cache without rep holds repeat 0; of several rows of one request and repeat one counts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", ll double, is_greedy boolean, text string"
    if cache is None:
        return asked.mapInPandas(scorer, schema)
    known = cache if "rep" in cache.columns else cache.withColumn("rep", F.lit(0))
    known = known.groupBy("req_hash", "rep").agg(F.min(F.struct("ll", "is_greedy", "text")).alias("known")).select("req_hash", "rep", "known.*")
    hit = asked.join(known, ["req_hash", "rep"]).select(*asked.columns, "ll", "is_greedy", "text")
    return hit.unionByName(asked.join(known, ["req_hash", "rep"], "left_anti").select(*asked.columns).mapInPandas(scorer, schema))


def sample_metrics(task: Task, responses: DataFrame) -> DataFrame:
    """(task, filter, doc_id, metric, v, w, gold, pred): a long table, one row a score; w, gold and pred where the metric names them.

    Scores see target, choices and, by output type: lls and (if asked) unconditional; prediction and filtered; ll, is_greedy, words and bytes of the target.
    """
    docs = task.process(task.docs) if task.process else task.docs
    gold = docs.select("doc_id", task.target.alias("target"), *([task.choices.alias("choices")] if task.choices is not None else []))
    if task.output_type == "multiple_choice":
        lls = regroup(responses.where("rep = 0"), ["doc_id"], "ll", ["idx"]).withColumnRenamed("texts", "lls").withColumn("filter", F.lit("none"))
        if task.unconditional:
            half = F.expr("size(lls) div 2")
            lls = lls.withColumn("unconditional", F.slice("lls", half + 1, half)).withColumn("lls", F.slice("lls", F.lit(1), half))
    elif task.output_type == "generate_until":
        texts = regroup(responses, ["doc_id"], "text", ["idx", "rep"])
        lls = apply_chains(texts, task.filters).withColumn("prediction", F.element_at("filtered", 1))
    else:
        lls = responses.where("rep = 0").groupBy("doc_id").agg(F.sum("ll").alias("ll"), F.bool_and("is_greedy").alias("is_greedy")).withColumn("filter", F.lit("none"))
        gold = gold.withColumns({"words": F.size(words(F.col("target"))), "bytes": F.octet_length("target")})
    part = lambda f, kind: (f() if f else F.lit(None)).cast(kind)
    rows = F.inline(F.array(*[F.struct(F.lit(m.name).alias("metric"), m.score().cast("double").alias("v"), part(m.weight, "double").alias("w"), part(m.gold, "string").alias("gold"), part(m.pred, "string").alias("pred")) for m in task.metrics]))
    return lls.join(gold, "doc_id").select(F.lit(task.name).alias("task"), "filter", "doc_id", rows)


def _corpus_value(part: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, value, n) of a metric over all (gold, pred) pairs of a task."""
    n = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if kind == "f1":
        r = part.groupBy(*keys).agg(M.f1_binary(positive="1").alias("value"))
    elif kind in ("mcc", "macro_f1", "weighted_f1", "micro_f1"):
        r = M.classification(part, keys).select(*keys, F.col(kind).alias("value"))
    else:
        r = {"bleu": translation.bleu, "chrf": translation.chrf, "ter": translation.ter}[kind](part.select(*keys, "pred", F.col("gold").alias("ref")), keys).select(*keys, F.col(kind).alias("value"))
    return r.join(n, keys)


CORPUS_LEVEL = ("f1", "mcc", "macro_f1", "weighted_f1", "micro_f1", "bleu", "chrf", "ter")


def task_results(samples: DataFrame, aggregation: dict[str, str] | None = None, bootstrap: int = 0) -> DataFrame:
    """(task, filter, metric, value, stderr, n, higher_is_better); one grouped aggregation for each kind of aggregate."""
    how = aggregation or {}
    keys = ["task", "filter", "metric"]
    kinds = sorted({"mean", *how.values()})
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"": "mean", **how}.items() for x in kv]), F.col("metric")), F.lit("mean"))
    out = None
    for k in kinds:
        part = samples.where(kind == k)
        if k in CORPUS_LEVEL or k == "median":
            r = _corpus_value(part, keys, k) if k in CORPUS_LEVEL else M.median(part, keys)
            if bootstrap and k in M.BOOTSTRAPPED_PAIRS | M.BOOTSTRAPPED:
                error = bootstrap_pairs(part, keys, k, bootstrap) if k in CORPUS_LEVEL else bootstrap_stderr(part, keys, bootstrap, of=k)
                r = r.join(error, keys, "left").select(*keys, "value", "stderr", "n")
            else:
                r = r.select(*keys, "value", F.lit(None).cast("double").alias("stderr"), "n")
            out = r if out is None else out.unionByName(r)
            continue
        error = M.stderr() if k in M.CLOSED_FORM_ERROR else F.lit(None).cast("double")
        r = part.groupBy(*keys).agg(M.AGGREGATIONS[k]().alias("value"), error.alias("stderr"), F.count(F.lit(1)).alias("n"))
        if bootstrap and k in M.BOOTSTRAPPED:
            r = r.drop("stderr").join(bootstrap_stderr(part, keys, bootstrap, of=k), keys, "left").select(*keys, "value", "stderr", "n")
        out = r if out is None else out.unionByName(r)
    return out.withColumn("higher_is_better", ~F.col("metric").isin(sorted(M.LOWER_IS_BETTER)))


def group_results(results: DataFrame, groups: list[Group]) -> DataFrame:
    """(group, filter, metric, value, stderr, n): for each of a group's metrics its members' results pooled, however deep they stand.

    A member without a metric does not count for it; a missing error leaves the group's null, and a group of which no member has a metric has no row for it.
    """
    spark = results.sparkSession
    known = {g.name: g for g in groups}

    def leaves(name: str, path=()) -> list[str]:
        if name in path:
            raise ValueError(f"group {name} holds itself")
        return [x for m in known[name].members for x in leaves(m, (*path, name))] if name in known else [name]

    seen: dict[str, str] = {}
    for g in groups:
        for m in g.members:
            if seen.setdefault(m, g.name) != g.name:
                raise ValueError(f"{m} is in {seen[m]} and {g.name}")
    edges = spark.createDataFrame([(g.name, t, a.metric, f, a.weight_by_size) for g in groups for t in dict.fromkeys(leaves(g.name)) for a in g.rolled_up for f in a.filters], "`group` string, task string, metric string, filter string, by_size boolean")
    j = results.join(F.broadcast(edges), ["task", "metric", "filter"])
    complete = F.count("stderr") == F.count(F.lit(1))
    return j.groupBy("group", "filter", "metric").agg(F.when(F.first("by_size"), weighted_mean()).otherwise(weighted_mean(by_size=False)).alias("value"), F.when(complete, pooled_stderr()).alias("stderr"), F.sum("n").alias("n"))


def evaluate(spark: SparkSession, tasks: list[Task], scorer: Scorer, cache: DataFrame | None = None, bootstrap: int = 0) -> DataFrame:
    """Results of all tasks; every task is one plan and they are united before aggregation.

    The model is asked once a request: where the scores are read more than once, for several kinds of aggregation, medians or bootstrap errors, they are written first.
    """
    samples = None
    how: dict[str, str] = {}
    for t in tasks:
        s = sample_metrics(t, cached_or_scored(requests(t), scorer, cache))
        samples = s if samples is None else samples.unionByName(s)
        how |= {m.name: m.aggregation for m in t.metrics}
    if bootstrap or "median" in how.values() or len({"mean", *how.values()}) > 1:
        samples = written(samples, "samples")
    return task_results(samples, how, bootstrap)


def markdown(results: DataFrame) -> str:
    """A table of (small) results: sorted, four decimals, arrows for the better direction."""
    lines = ["|task|filter|metric| |value| |stderr|", "|---|---|---|---|---:|---|---:|"]
    for r in results.orderBy("task", "metric", "filter").collect():
        arrow = "↑" if r.higher_is_better else "↓"
        lines.append(f"|{r.task}|{r.filter}|{r.metric}|{arrow}|{r.value:.4f}|±|{'N/A' if r.stderr is None else f'{r.stderr:.4f}'}|")
    return "\n".join(lines)
