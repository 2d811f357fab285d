"""Tables kept under the configuration that made them, such as a task's requests or the overlaps of a task with a corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def config_key(config: dict) -> str:
    """A name for a configuration, whatever the order of its keys; values that JSON doesn't know go by their text."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:24]


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cached(spark: SparkSession, folder: str, prefix: str, config: dict, make: Callable[[], DataFrame], rewrite: bool = False) -> DataFrame:
    """The table that make() gives, written once for each configuration and read from then on. A table that a lost driver left half written has no _SUCCESS and is made again. folder must be shared by all executors."""
    path = f"{folder.rstrip('/')}/{prefix}-{config_key(config)}"
    fs, done = _folder(spark, f"{path}/_SUCCESS")
    if rewrite or not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def forget(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Delete the tables of a prefix, all of them without one; their names."""
    fs, root = _folder(spark, folder)
    gone = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if status.isDirectory() and (name.rpartition("-")[0] == prefix if prefix else "-" in name):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
