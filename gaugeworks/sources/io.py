"""Sources and sinks: corpora of JSON lines (plain, gzip or zstd), text lines, sample logs, results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, joiner: str = "\n\n") -> DataFrame:
    """(text, meta) of JSON lines: text may be a string or an array of paragraphs, and a row may be a bare string."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    text, meta = F.get_json_object("value", "$.text"), F.get_json_object("value", "$.meta")
    many = F.from_json(text, "array<string>")
    bare = F.from_json(F.concat(F.lit('{"x":'), "value", F.lit("}")), "x string")["x"]
    joined = F.when(F.startswith(F.ltrim(text), F.lit("[")) & many.isNotNull(), F.array_join(many, joiner)).otherwise(text)
    return raw.select(F.when(F.startswith(F.ltrim("value"), F.lit('"')), bare).otherwise(joined).alias("text"), meta.alias("meta"))


def write_corpus(df: DataFrame, path: str, codec: str = "gzip") -> None:
    df.write.option("compression", codec).json(path)


def read_dataset(spark: SparkSession, splits: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """One table of several splits with their name in split."""
    out = None
    for name, path in splits.items():
        part = spark.read.format(fmt).load(path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample logs with task and time taken from the file's name, samples_<task>_<time>.jsonl."""
    df = spark.read.json(path).withColumn("__file", F.col("_metadata.file_name"))
    name = r"samples_(.*)_(\d{4}-\d{2}-\d{2}T[\d\-.:]+)\.jsonl"
    return df.withColumns({"task": F.regexp_extract("__file", name, 1), "run_at": F.regexp_extract("__file", name, 2)}).drop("__file")


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.partitionBy("task").json(path)


def task_hash(hashes: str = "hash", order: str = "doc_id") -> Column:
    """sha256 of the samples' hashes in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, hashes)))
    return F.sha2(F.array_join(F.transform(rows, lambda x: x[hashes]), ""), 256)


def results_json(results: DataFrame) -> str:
    """Aggregated results (a small table) as the nested JSON of a run."""
    out: dict = {}
    for r in results.collect():
        out.setdefault(r.task, {})[f"{r.metric},{r.filter}"] = r.value
        out[r.task][f"{r.metric}_stderr,{r.filter}"] = "N/A" if r.stderr is None else r.stderr
    return json.dumps({"results": out}, sort_keys=True, indent=1)
