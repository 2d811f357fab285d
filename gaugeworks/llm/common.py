"""Helpers shared by the corpus operators: word rules, shared scratch tables, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed by the contracts: words are runs of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Keep the batches that Python gets small in bytes, whatever the texts' length, unless the session has a bound of its own."""
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's default
        spark.conf.set(_BATCH, most)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back. What the write shuffled is deleted once it is done."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by materialize() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a written table if it has at most max_rows rows; else leave the choice of join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_bytes(column: str = "text") -> Column:
    """Null texts count as empty; binary spares Python the decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def word_hashes(texts: list[bytes], endings: bool = False) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of every word of the texts, and the number of words of each text; with endings, a 16-bit code of each word's last two bytes and length too."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    blank = _BLANK[data]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.diff(np.searchsorted(begin, np.cumsum(size + 1) + 1), prepend=0)
    if not len(begin):
        return (np.zeros(0, np.uint64), words, np.zeros(0, np.uint16))[: 2 + endings]
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    length = end - begin
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()) - 1, _BASE, np.uint64)), dtype=np.uint64)
    h = np.add.reduceat((data[~blank].astype(np.uint64) + np.uint64(1)) * power[at], np.cumsum(length) - length)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    if not endings:
        return h, words
    code = (data[end - 1].astype(np.uint32) * 256 + data[end - 2] * (length > 1)) * 31 + np.minimum(length, 24)
    return h, words, (code * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def pieces(batch, column: int, budget: int = 3 << 20):
    """Split an Arrow record batch into slices of about budget bytes of the given column (one row at least)."""
    sizes = np.asarray(batch.column(column).value_lengths().fill_null(0) if hasattr(batch.column(column), "value_lengths") else _lengths(batch.column(column)))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def _lengths(array):
    import pyarrow.compute as pc

    return pc.binary_length(array).fill_null(0)


HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_counted(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows joined to side on key; both are written tables, and side has one row a key with n, the number of rows of that key.

    Keys of very many rows would each fill a task; there are at most HOT_KEYS of more than a HOT_KEYS-th of all rows, and these are broadcast.
    """
    cut = max(HOT_ROWS, (side.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot, cold = side.where(F.col("n") > cut).drop("n"), side.where(F.col("n") <= cut).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by randomised contraction: a written table (node, root) of every node with an edge.

    edges has long columns u and v. Each round every node points to the neighbour, or itself,
    with the least hash; edges are relabelled and loops dropped, which leaves at most three
    quarters of the nodes in expectation whatever the shape of the graph. Only joins and min
    aggregates are used, so no neighbourhood is ever gathered. An empty input gives no rows.
    """
    e = edges.where("u <> v").select("u", "v")
    e = materialize(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        rank = lambda c, k=len(steps): F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("x"))
        step = e.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.when(rank("u") < F.col("m"), F.col("u")).otherwise(F.col("m.x")).alias("r"))
        step = materialize(step, "contraction")
        at = step.select(F.col("u").alias("v"), F.col("r").alias("s"))
        nxt = materialize(e.join(step, "u").join(at, "v").where("r <> s").select(F.col("r").alias("u"), F.col("s").alias("v")).distinct(), "edges")
        discard(e)
        e = nxt
        steps.append(step)
    if not steps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    discard(e)
    out = steps[0].select(F.col("u").alias("node"), F.col("r").alias("root"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("u").alias("root"), "r"), "root", "left").select("node", F.coalesce("r", "root").alias("root"))
    out = materialize(out, "components")
    discard(*steps)
    return out
