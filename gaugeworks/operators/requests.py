"""From documents to scoring requests and back: choices, repeats, windows, few-shot contexts, chat, expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import kth, numbered
from ..functions.text import let


def multiple_choice(docs: DataFrame, context: Column, choices: Column, delimiter: str = " ") -> DataFrame:
    """(doc_id, idx, context, continuation): a request for each choice."""
    return docs.select("doc_id", context.alias("context"), F.posexplode(choices).alias("idx", "choice")).select("doc_id", "idx", "context", F.concat(F.lit(delimiter), "choice").alias("continuation"))


def repeated(requests: DataFrame, times: int) -> DataFrame:
    """Each request times over, numbered in rep."""
    return requests.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def regroup(responses: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, texts): responses of each key in order."""
    return responses.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias("texts"))


def rolling_windows(tokens: Column, prefix: Column, max_len: int, context: int = 1) -> Column:
    """Array of (input, predicted): every token is predicted once; later windows see up to max_len tokens. No tokens, no windows."""
    return let(tokens, lambda t: _windows(t, prefix, max_len, context))


def _windows(tokens: Column, prefix: Column, max_len: int, context: int) -> Column:
    n, step = F.size(tokens), max_len - context + 1
    first = F.struct(F.concat(F.array(prefix), F.slice(tokens, 1, F.greatest(F.least(n, F.lit(max_len)) - 1, F.lit(0)))).alias("input"), F.slice(tokens, 1, max_len).alias("predicted"))

    def window(done):
        size = F.least(n - done, F.lit(step))
        end = done + size
        begin = F.greatest(end - max_len - 1, F.lit(0))
        return F.struct(F.slice(tokens, begin + 1, end - 1 - begin).alias("input"), F.slice(tokens, done + 1, size).alias("predicted"))

    later = F.when(n > max_len, F.transform(F.sequence(F.lit(max_len), F.greatest(n - 1, F.lit(max_len)), F.lit(step)), window))
    none = F.slice(F.array(first), 1, 0)
    return F.when(n > 0, F.concat(F.array(first), F.coalesce(later, none))).otherwise(none)


def disjoint(window: Column) -> Column:
    """The window with its input cut so that it doesn't overlap what is predicted."""
    keep = F.size(window["input"]) - (F.size(window["predicted"]) - 1)
    return F.struct(F.slice(window["input"], 1, keep).alias("input"), window["predicted"].alias("predicted"))


def truncate(tokens: Column, most: int, side: str = "left") -> Column:
    """Keep most tokens: the last (left cut), the first (right), or both ends (middle)."""
    if side == "middle":
        half = most // 2
        return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, half), F.slice(tokens, F.size(tokens) - (most - half) + 1, most - half)))
    start = F.greatest(F.size(tokens) - most + 1, F.lit(1)) if side == "left" else F.lit(1)
    return F.slice(tokens, start, most)


def _examples(docs: DataFrame, pool: DataFrame, n: int, sampler: str, seed: int) -> DataFrame:
    """(doc_id, text, picked): n examples of the pool for each document, as struct(place, pool_id, text, target) in order, never the document itself."""
    ranked = pool.select(F.col("doc_id").alias("pool_id"), F.col("text").alias("shown"), "target")
    none = F.slice(F.array(F.struct(F.lit(0).alias("place"), F.lit(0).alias("pool_id"), F.lit("").alias("text"), F.lit("").alias("target"))), 1, 0)
    if sampler == "first_n":
        top = [F.struct(F.lit(r.pool_id).alias("place"), F.lit(r.pool_id).alias("pool_id"), F.lit(r.shown).alias("text"), F.lit(r.target).alias("target")) for r in ranked.orderBy("pool_id").limit(n + 1).collect()]
        if 0 < len(top) < n:
            raise ValueError(f"{n} examples asked of {len(top)}")
        if not top:
            return docs.select("doc_id", "text", none.alias("picked"))
        j = docs.select("doc_id", "text", F.array(*top).alias("some"))
    else:
        size = pool.count()
        if not size:
            return docs.select("doc_id", "text", none.alias("picked"))
        ring = numbered(ranked.withColumn("draw", F.struct(F.xxhash64(F.lit(seed), "pool_id"), "pool_id")), "draw").withColumnRenamed("offset", "rank").drop("draw")
        drawn = F.transform(F.sequence(F.lit(0), F.lit(4 * n + 8)), lambda k: F.pmod(F.xxhash64(F.lit(seed), "doc_id", k), F.lit(size)))
        rest = F.transform(F.sequence(F.lit(0), F.lit(min(n, size - 1))), lambda k: F.pmod(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(size)) + k, F.lit(size)))
        places = F.slice(F.array_distinct(F.concat(drawn, rest)), 1, n + 1)
        want = docs.select("doc_id", "text", F.posexplode(places).alias("place", "rank"))
        j = want.join(ring, "rank").groupBy("doc_id", "text").agg(F.collect_list(F.struct("place", "pool_id", F.col("shown").alias("text"), "target")).alias("some"))
    return j.select("doc_id", "text", F.slice(F.filter(F.array_sort("some"), lambda x: x["pool_id"] != F.col("doc_id")), 1, n).alias("picked"))


def few_shot(docs: DataFrame, pool: DataFrame, n: int, sampler: str = "first_n", seed: int = 1234, target_delimiter: str = " ", delimiter: str = "\n\n") -> DataFrame:
    """(doc_id, context): n examples of the pool (doc_id, text, target) before each document, never the document itself.

    first_n takes the first by doc_id, an error if the pool has some but fewer: only n + 1 rows of it can serve, whatever its size. default draws by hash: every
    document draws places of the pool in hash order of its own (and should too few differ, the next ones from one place on), so a
    document meets n + 1 rows, not the pool; an empty pool gives none. An empty target adds neither its delimiter nor itself.
    """
    shown = lambda x: F.when(x["target"] == "", x["text"]).otherwise(F.concat(x["text"], F.lit(target_delimiter), x["target"]))
    j = _examples(docs, pool, n, sampler, seed)
    return j.select("doc_id", F.concat(F.array_join(F.transform("picked", lambda x: F.concat(shown(x), F.lit(delimiter))), ""), "text").alias("context"))


def few_shot_chat(docs: DataFrame, pool: DataFrame, n: int, sampler: str = "first_n", seed: int = 1234, system: str = "", prefix: str = "") -> DataFrame:
    """(doc_id, messages): an optional system message, each example as a turn of the user and one of the assistant, and the document as the user's last; prefix opens every answer."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    answer = lambda x: F.concat(F.lit(prefix + " " if prefix else ""), x["target"])
    turns = F.flatten(F.transform("picked", lambda x: F.array(say("user", x["text"]), say("assistant", answer(x)))))
    opening = [F.array(say("system", F.lit(system)))] if system else []
    return _examples(docs, pool, n, sampler, seed).select("doc_id", F.concat(*opening, turns, F.array(say("user", F.col("text")))).alias("messages"))


def chat(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, messages): role and content of each turn in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def collect_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key; its values in order of first sight."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def expand_templates(docs: DataFrame, templates: list[str], column: str = "text") -> DataFrame:
    """A row for each document and template, {} standing for the column."""
    made = F.array(*[F.struct(F.lit(i).alias("prompt_id"), F.replace(F.lit(t), F.lit("{}"), F.col(column)).alias("prompt")) for i, t in enumerate(templates)])
    return docs.select("*", F.inline(made))


def expand_options(docs: DataFrame, options: str = "choices", gold: str = "gold") -> DataFrame:
    """A row for each place of the right answer: it is swapped with the option at that place."""
    swapped = lambda k: F.transform(options, lambda x, i: F.when(i == k, F.get(options, F.col(gold))).when(i == F.col(gold), F.get(options, k)).otherwise(x))
    rest = [c for c in docs.columns if c not in (options, gold)]
    rows = F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda k: F.struct(k.alias("option"), swapped(k).alias(options), k.alias(gold)))
    return docs.select(*rest, F.inline(rows))


def limited(docs: DataFrame, limit: float, key: str = "doc_id") -> DataFrame:
    """First limit documents by key, a number; below 1 a share of them, rounded up. The last one's key is found by counts of ranges of keys, so nothing is sorted or gathered, and it bounds the scan."""
    n = F.expr(f"ceil(n * {limit}D)") if limit < 1 else F.lit(int(limit))
    last = kth(docs, [], key, F.least(n, F.col("n")) - 1, [key]).first()
    return docs.where(F.col(key) <= F.lit(last[0])) if last else docs.limit(0)


def chosen(docs: DataFrame, ids: list[int], key: str = "doc_id") -> DataFrame:
    """Documents of the given ids; an id that no document has is passed over."""
    return docs.where(F.col(key).isin([int(i) for i in ids]))


def shorter_than(docs: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Documents of at most most tokens."""
    return docs.where(F.size(tokens) <= most)


def shuffled(options: Column, *keys, seed: int = 42) -> Column:
    """The options in an order of their own for each key, drawn by hash; with equal options kept apart by their place."""
    ranked = F.transform(options, lambda x, i: F.struct(F.xxhash64(F.lit(seed), *keys, i).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


def without_prefixed(aliases: Column) -> Column:
    """Sorted distinct aliases but those that begin with one kept before."""
    keep = lambda kept, a: F.when((F.size(kept) > 0) & F.startswith(a, F.element_at(kept, -1)), kept).otherwise(F.concat(kept, F.array(a)))
    return F.aggregate(F.array_sort(F.array_distinct(aliases)), F.array().cast("array<string>"), keep)


def pair_encoded(context: Column, continuation: Column) -> Column:
    """struct(context, continuation): blanks at the end of the context move to the continuation."""
    blanks = F.regexp_extract(context, r"(?U)([\s\x1c-\x1f]*)\z", 1)
    return F.struct(F.substr(context, F.lit(1), F.length(context) - F.length(blanks)).alias("context"), F.concat(blanks, continuation).alias("continuation"))


def spans_of(tokens: Column, size: int) -> Column:
    """Runs of size tokens, the last one shorter."""
    return let(tokens, lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(size)), lambda a: F.slice(t, a + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>")))


def consolidated(results: DataFrame) -> DataFrame:
    """(task, results): a task's values by "metric,filter" and errors by "metric_stderr,filter", as a map."""
    pair = F.array(F.struct(F.concat_ws(",", "metric", "filter").alias("k"), F.col("value").alias("v")), F.struct(F.concat(F.col("metric"), F.lit("_stderr,"), F.col("filter")).alias("k"), F.col("stderr").alias("v")))
    return results.select("task", F.inline(pair)).groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("results"))


def direction(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, metric, higher_is_better): null where the members of a group (edges: group, task) disagree."""
    j = results.join(edges, "task").groupBy("group", "metric").agg(F.min("higher_is_better").alias("a"), F.max("higher_is_better").alias("b"))
    return j.select("group", "metric", F.when(F.col("a") == F.col("b"), F.col("a")).alias("higher_is_better"))


def sample_sizes(docs: DataFrame, task: str, limit: int | None = None) -> DataFrame:
    """(task, original, effective): documents of each task, and how many of them a limit leaves."""
    n = docs.groupBy(task).agg(F.count(F.lit(1)).alias("original"))
    return n.withColumn("effective", F.col("original") if limit is None else F.least("original", F.lit(limit).cast("long")))


def indented(edges: dict[str, list[str]], root: str) -> list[tuple[str, int]]:
    """Names under a root with their depth, alphabetical within a level."""
    out, todo = [], [(root, 0)]
    while todo:
        name, depth = todo.pop()
        out.append((name, depth))
        todo += [(m, depth + 1) for m in sorted(edges.get(name, ()), reverse=True)]
    return out


def regression(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """(on, before, after, delta, change): values of two runs side by side, rows of either kept; change is the sign of the difference."""
    j = before.select(*on, F.col("value").alias("before")).join(after.select(*on, F.col("value").alias("after")), on, "full")
    delta = F.col("after") - F.col("before")
    return j.select(*on, "before", "after", delta.alias("delta"), F.when(delta > 0, "+").when(delta < 0, "-").when(delta == 0, "=").alias("change"))


def seeds_joined(runs: list[DataFrame], on: list[str], v: str = "v") -> DataFrame:
    """Rows that all runs have, with each run's value as seed_0, seed_1, ... and whether they agree."""
    out = None
    for k, run in enumerate(runs):
        part = run.select(*on, F.col(v).alias(f"seed_{k}"))
        out = part if out is None else out.join(part, on)
    first = F.col("seed_0")
    agree = F.lit(True)
    for k in range(1, len(runs)):
        agree = agree & (F.col(f"seed_{k}") == first)
    return out.withColumn("agree", agree.cast("int"))


def shard(docs: DataFrame, rank: int, world: int) -> DataFrame:
    return docs.where(F.pmod("doc_id", F.lit(world)) == rank)


def unique_contexts(requests: DataFrame) -> DataFrame:
    """(context, asked): one row for each context with all its continuations, for scorers that share a forward pass."""
    return requests.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("doc_id", "idx", "continuation"))).alias("asked"))


def latest(df: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, by).alias(value))


def heatmap(df: DataFrame, row: str, column: str, values: list, v: str = "v") -> DataFrame:
    """Mean of non-negative values by row and listed column values."""
    return df.where(F.col(v) >= 0).groupBy(row).pivot(column, values).agg(F.avg(v))
