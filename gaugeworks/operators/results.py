"""Results and sample logs in the shapes that tables and viewers take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent_table(results: DataFrame, as_is: tuple[str, ...] = ("ppl",), tasks_as_is: tuple[str, ...] = ("squad2",)) -> DataFrame:
    """(task, metric, value, stderr) as texts of two decimals, in hundreds but for the metrics and tasks given; no error, an empty text."""
    times = F.when(F.col("metric").isin(*as_is) | F.col("task").isin(*tasks_as_is), 1.0).otherwise(100.0)
    show = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.call_function("format_number", F.col(c) * times, F.lit("0.00"))), F.lit(""))
    return results.select("task", "metric", show("value").alias("value"), show("stderr").alias("stderr"))


def with_bare_groups(results: DataFrame, groups: DataFrame) -> DataFrame:
    """Results and a row without metric or value for each group (column task) that has none, so that it still heads its members."""
    bare = groups.select("task").distinct().join(results.select("task"), "task", "left_anti")
    return results.unionByName(bare.withColumn("metric", F.lit(" ")), allowMissingColumns=True)


def arguments(requests: DataFrame) -> DataFrame:
    """(doc_id, arguments): a document's requests in order, as a map from gen_args_<i> to a map of arg_0 and arg_1."""
    one = F.struct("idx", F.create_map(F.lit("arg_0"), F.col("context"), F.lit("arg_1"), F.col("continuation")).alias("a"))
    # maps have no order, so the request's number goes first and is unique
    g = requests.groupBy("doc_id").agg(F.collect_list(one).alias("x"))
    return g.select("doc_id", F.map_from_entries(F.transform("x", lambda x: F.struct(F.concat(F.lit("gen_args_"), x["idx"].cast("string")), x["a"]))).alias("arguments"))


def _row_id(filtered: bool) -> Column:
    return F.concat_ws(".", F.col("doc_id").cast("string"), "filter") if filtered else F.col("doc_id").cast("string")


def viewer_documents(samples: DataFrame, output_type: str, filtered: bool = False) -> DataFrame:
    """(id, doc_id, data, input_len, labels, output_type) of samples (doc_id, filter, target, arguments) for an outside viewer; choices are listed under their context."""
    first = F.col("arguments")["gen_args_0"]
    data, labels = first["arg_0"], F.col("target")
    if output_type == "loglikelihood":
        labels = first["arg_1"]
    elif output_type == "multiple_choice":
        choice = lambda i: F.concat(F.lit("- "), F.col("arguments")[F.concat(F.lit("gen_args_"), i.cast("string"))]["arg_1"])
        data = F.concat(data, F.lit("\n\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.size("arguments") - 1), choice), "\n"))
    return samples.select(_row_id(filtered).alias("id"), "doc_id", data.alias("data"), F.length(data).alias("input_len"), labels.alias("labels"), F.lit(output_type).alias("output_type"))


def viewer_outputs(samples: DataFrame, output_type: str, metrics: list[str], filtered: bool = False) -> DataFrame:
    """(id, doc_id, output, metrics) of samples (doc_id, filter, lls, is_greedy, text) for an outside viewer."""
    output = {
        "loglikelihood": lambda: F.when(F.col("is_greedy"), "correct").otherwise("incorrect"),
        "multiple_choice": lambda: F.array_join(F.transform("lls", lambda x: x.cast("string")), ", "),
        "loglikelihood_rolling": lambda: F.col("ll").cast("string"),
        "generate_until": lambda: F.col("text"),
    }[output_type]()
    return samples.select(_row_id(filtered).alias("id"), "doc_id", output.alias("output"), *metrics)


def answer_rows(docs: DataFrame, answers: str = "answers") -> DataFrame:
    """A row for each answer of a document; documents without answers go."""
    return docs.withColumn(answers, F.explode(answers))


def group_difference(results: DataFrame, minuend: str, subtrahend: str, on: list[str]) -> DataFrame:
    """(on, value): one member's value less another's, a group's metric."""
    at = lambda task: F.max(F.when(F.col("task") == task, F.col("value")))
    return results.where(F.col("task").isin(minuend, subtrahend)).groupBy(*on).agg((at(minuend) - at(subtrahend)).alias("value"))


def collated(requests: DataFrame, by: list[str], length: Column, size: int, partitions: int, key: str = "doc_id") -> DataFrame:
    """Requests with their batch: equal values of by share a batch, the longest come first, and a batch has up to size rows.

    Requests are cut into ranges of (by, length, key), numbered within a range by one sort, and batches never cross ranges:
    no group meets in one task, at the cost of a short last batch for each range. Joining by key restores the input's order.
    """
    from pyspark.sql import Window

    order = [*[F.col(c) for c in by], F.col("__len").desc(), F.col(key)]
    ranged = requests.withColumn("__len", length).repartitionByRange(partitions, *order).withColumn("__part", F.spark_partition_id())
    # the same partition's rows of one batch kind: sorted once more by Spark, but spread over as many groups as there are ranges
    n = F.row_number().over(Window.partitionBy("__part", *by).orderBy(F.col("__len").desc(), key))
    batch = F.struct("__part", *by, F.floor((n - 1) / size).alias("n"))
    return ranged.withColumn("batch", batch).drop("__part", "__len")
