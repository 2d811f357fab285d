"""Synthetic long-context tasks, drawn by hash of seed and row: needles in a haystack, chains of variables, common words. Every row is made where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(seed: int, *key) -> Column:
    return F.xxhash64(F.lit(seed), *key)


def _name(seed: int, n: int, *key) -> Column:
    """n capital letters."""
    h = _draw(seed, *key)
    return F.concat(*[F.char(F.lit(65) + F.pmod(F.shiftright(h, 5 * j), F.lit(26)).cast("int")) for j in range(n)])


def haystack(spark: SparkSession, lengths: list[int], depths: list[int], rows: int, noise: list[str], needle: str = "The magic number of {key} is {value}.", seed: int = 42) -> DataFrame:
    """(id, length, depth, query, input, outputs): for each length in sentences and depth in hundredths, rows texts of noise sentences with one needle, a seven-digit number under a key of its own, after depth % of the sentences."""
    grid = spark.range(rows).withColumn("length", F.explode(F.array(*map(F.lit, lengths)))).withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    cell = ("id", "length", "depth")
    key = _name(seed, 8, F.lit("key"), *cell)
    value = (F.lit(1000000) + F.pmod(_draw(seed, F.lit("value"), *cell), F.lit(9000000))).cast("string")
    filled = F.replace(F.replace(F.lit(needle), F.lit("{key}"), F.col("query")), F.lit("{value}"), F.col("outputs")[0])
    sentences = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.get(F.array(*map(F.lit, noise)), i % len(noise)))
    place = F.floor(F.col("length") * F.col("depth") / 100).cast("int") + 1
    return grid.withColumns({"query": key, "outputs": F.array(value)}).select(*cell, "query", F.array_join(F.array_insert(sentences, place, filled), " ").alias("input"), "outputs")


def variable_chains(spark: SparkSession, rows: int, chains: int, hops: int, noise: str, every: int = 3, seed: int = 42) -> DataFrame:
    """(id, query, input, outputs): chains of hops assignments, VAR A = 12345, VAR B = VAR A, ..., dealt in order among noise; outputs are the names of the first chain, which all hold the value asked for. Names differ by their last letter, so at most 26 fit."""
    total = chains * (hops + 1)
    if total > 26:
        raise ValueError("at most 26 variables")
    name = lambda c, h: F.concat(_name(seed, 4, "id", F.lit(c), F.lit(h)), F.lit(chr(65 + c * (hops + 1) + h)))
    value = lambda c: (F.lit(10000 + 1000 * c) + F.pmod(_draw(seed, F.lit("value"), "id", F.lit(c)), F.lit(1000))).cast("string")
    lines = []
    for h in range(hops + 1):  # chains take turns, so each keeps its order
        for c in range(chains):
            lines.append(F.concat(F.lit("VAR "), name(c, h), F.lit(" = "), value(c) if h == 0 else F.concat(F.lit("VAR "), name(c, h - 1))))
    text = F.array_join(F.flatten(F.array(*[F.array(*[F.lit(noise)] * every, line) for line in lines])), " ")
    return spark.range(rows).select("id", value(0).alias("query"), text.alias("input"), F.array(*[name(0, h) for h in range(hops + 1)]).alias("outputs"))


def common_words(spark: SparkSession, rows: int, common: int, others: int, often: int = 30, seldom: int = 3, seed: int = 42) -> DataFrame:
    """(id, input, outputs): a numbered list of words in drawn order, the common ones often and the others seldom; outputs are the common ones. Words are drawn letters and their number, so no two are equal."""
    if often <= seldom:
        raise ValueError("common words must come more often")
    word = lambda i: F.concat(F.lower(_name(seed, 5, "id", i)), i.cast("string"))
    d = spark.range(rows).withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(common + others - 1)), word))
    copies = F.flatten(F.transform("w", lambda w, i: F.transform(F.sequence(F.lit(1), F.when(i < common, often).otherwise(seldom)), lambda k: F.struct(F.xxhash64(F.lit(seed), w, k).alias("r"), w.alias("w"), k.alias("k")))))
    listed = F.transform(F.array_sort(copies), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["w"]))
    return d.select("id", F.array_join(listed, " ").alias("input"), F.slice("w", 1, common).alias("outputs"))
