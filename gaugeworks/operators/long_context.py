"""Long contexts packed from given tables: documents fill a budget of words, a needle is put at a depth among them, and a prompt is split back into its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.scratch import written

JOINER = "\n\n"


def strewn(docs: DataFrame, key: str, seed: int = 42, text: str = "text") -> DataFrame:
    """(start, size, text): documents of a word at least in an order drawn by hash, with the words before each; written.

    The order is laid out by ranges over all tasks; the words before a range follow from the sums of the ranges before it.
    """
    rows = docs.select(F.xxhash64(F.lit(seed), key).alias("draw"), F.col(key).alias("key"), F.size(words(F.col(text))).cast("long").alias("size"), F.col(text).alias("text")).where("size > 0")
    laid = written(rows.repartitionByRange("draw", "key").sortWithinPartitions("draw", "key").withColumn("part", F.spark_partition_id()), "context-order")
    sums = laid.groupBy("part").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    within = F.sum("size").over(Window.partitionBy("part").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1))
    placed = laid.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(sums.select("part", before.alias("before"))), "part")
    return written(placed.select((F.col("before") + F.col("within")).alias("start"), "size", "text"), "context-strewn")


def packed(items: DataFrame, key: str, needle: str, docs: DataFrame, doc_key: str, budgets: list[int], depths: list[int], seed: int = 42) -> DataFrame:
    """(key, budget, depth, input, n_docs, context_words, before_words): for each item, budget in words and depth in hundredths a context with the item's needle in it.

    Whole documents that stand in a row in a drawn order, from a place drawn for the item, budget and depth, fill the budget (around its end back to its start); one
    that the budget cuts stays out. The needle comes after the documents that end within depth % of the context's words. A corpus smaller than a budget is taken
    whole. An item whose budget no document fits has a context of the needle alone. Documents meet the items by stretches of the greatest budget's length, so no item meets the whole corpus.
    """
    row = strewn(docs, doc_key, seed)
    total = row.agg(F.sum("size")).first()[0] or 0
    asked = items.select(F.col(key).alias("k"), F.col(needle).alias("needle")).withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in budgets]))).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    asked = asked.withColumn("budget_used", F.least("budget", F.lit(max(total, 1)))).withColumn("first", F.when(F.col("budget") < total, F.pmod(F.xxhash64(F.lit(seed), "k", "budget", "depth"), F.lit(max(total, 1)).cast("long"))).otherwise(0))
    stride = max(budgets)
    ends = F.col("first") + F.col("budget_used")
    asked = asked.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / stride), F.floor(ends / stride))))
    again = row.where(F.col("start") < stride).withColumn("start", F.col("start") + total)  # around the end
    laps = row.unionByName(again).withColumn("stretch", F.floor(F.col("start") / stride))
    met = asked.join(laps, (asked.stretch == laps.stretch) & (F.col("start") >= F.col("first")) & (F.col("start") + F.col("size") <= ends), "left").drop("stretch")
    held = met.groupBy("k", "needle", "budget", "depth", "first").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct((F.col("start") - F.col("first")).alias("at"), "size", "text")))).alias("docs"))
    held = held.withColumn("context_words", F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + x["size"]))
    base = F.coalesce(F.get("docs.at", F.lit(0)), F.lit(0).cast("long"))
    early = F.filter("docs", lambda x: (x["at"] - base + x["size"]) * 100 <= F.col("depth") * F.col("context_words"))
    held = held.withColumn("early", early).withColumn("late", F.slice("docs", F.size("early") + 1, F.size("docs") - F.size("early")))
    body = F.array_join(F.concat(F.col("early.text"), F.array("needle"), F.col("late.text")), JOINER)
    return held.select(F.col("k").alias(key), "budget", "depth", body.alias("input"), F.size("docs").alias("n_docs"), "context_words", F.aggregate("early", F.lit(0).cast("long"), lambda s, x: s + x["size"]).alias("before_words"))


def prompt(context: Column, question: Column, instruction: str, prefix: str) -> Column:
    """One text: the instruction, the context, the question on lines of their own, and what the answer begins with."""
    return F.concat(F.lit(instruction + "\n\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n" + prefix))


def split_prompt(text: Column, instruction: str, prefix: str, marker: str = "\n\nQuestion: ") -> Column:
    """struct(context, question, query, prefix): the parts of a prompt by its last marker; query is question and prefix as asked after a context. Without a marker all is context."""
    head, tail = instruction + "\n\n", "\n" + prefix
    body = F.when(F.startswith(text, F.lit(head)), F.substr(text, F.lit(len(head) + 1))).otherwise(text)
    bare = F.when(F.endswith(body, F.lit(tail)), F.substr(body, F.lit(1), F.length(body) - len(tail))).otherwise(body)
    has = F.contains(bare, F.lit(marker))
    context = F.when(has, F.regexp_extract(bare, r"(?s)\A(.*)\Q" + marker + r"\E", 1)).otherwise(bare)
    question = F.when(has, F.substring_index(bare, marker, -1)).otherwise(F.lit(""))
    given = F.when(F.endswith(text, F.lit(tail)), F.lit(prefix)).otherwise(F.lit(""))
    return F.struct(context.alias("context"), question.alias("question"), F.when(has, F.concat(F.lit(marker.strip()), F.lit(" "), question, F.lit("\n"), given)).otherwise(F.lit("")).alias("query"), given.alias("prefix"))


def keeps_raw(context_len: Column, fixed_len: Column, reserved: int, budget: int, max_len: int, threshold: int, enabled: bool = True) -> Column:
    """Whether a context is short enough to be given as it is: context, fixed parts and what generation needs fit the budget and the model, and stay under the threshold from which contexts are compressed."""
    total = context_len + fixed_len + F.lit(reserved)
    return F.lit(enabled) & (context_len > 0) & (total <= budget) & (total <= max_len) & (total < threshold)
