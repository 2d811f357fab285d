"""Places in an order without one task that sorts all: the k-th row of a group or a table by counts of ranges, and the numbers of all rows by ranges laid out over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import removed, written

#: Ranges of a pass, the rows that a last pass may sort for one group, and the groups whose ranges are broadcast.
RANGES, SORTED, GROUPS = 4_096, 50_000, 20_000


def kth(df: DataFrame, keys: list[str], order: str, place: Column, values: list[str]) -> DataFrame:
    """(keys, values, n) of the row with place rows before it by order, then by values; place is an expression over n, the group's rows; no value may be named n.

    order is numeric; rows without one don't count, and a place beyond the group gives no row. Each pass counts a group's rows by RANGES equal ranges
    between its least and greatest key, within tasks first, so a row for each group and range is all that is shuffled; the range of the place is fitted to its own least and greatest
    key and looked into next, until SORTED rows are left in each group's range or all their keys are equal. Evenly spread keys take two passes, any keys a few.
    """
    one = not keys
    keys = keys or ["__all"]
    rows = df.where(F.col(order).isNotNull()).select(*([F.lit(0).alias("__all")] if one else keys), *dict.fromkeys([order, *values]))
    x = F.col(order)
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    state = written(state.withColumn("n", F.col("__n")).withColumn("__rest", place.cast("long")).where("__rest BETWEEN 0 AND n - 1"), "kth-state")

    def inside():
        if one and (s := state.first()):  # plain bounds reach the scan
            return rows.where(x.between(s["__lo"], s["__hi"])).select("*", *[F.lit(s[c]).alias(c) for c in ("__lo", "__hi", "__rest", "n")])
        some = F.broadcast(state.drop("__n")) if state.limit(GROUPS + 1).count() <= GROUPS else state.drop("__n")
        return rows.join(some, keys).where(x.between(F.col("__lo"), F.col("__hi")))

    while not state.where((F.col("__n") > SORTED) & (F.col("__lo").cast("double") < F.col("__hi").cast("double"))).isEmpty():
        at = F.coalesce(F.width_bucket(x.cast("double"), F.col("__lo").cast("double"), F.col("__hi").cast("double"), F.lit(RANGES)), F.lit(0))
        ranges = inside().groupBy(*keys, "n", "__rest", at.alias("__range")).agg(F.count(F.lit(1)).alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range"))
        held = ranges.withColumn("__upto", upto).where("__rest < __upto AND __rest >= __upto - __n").withColumn("__rest", F.col("__rest") - F.col("__upto") + F.col("__n"))
        found = written(held.select(*keys, "__n", "__lo", "__hi", "n", "__rest"), "kth-state")
        removed(state)
        state = found
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *[v for v in values if v != order]))
    return inside().withColumn("__at", number - 1).where("__at = __rest").select(*([] if one else keys), *values, "n")


def numbered(docs: DataFrame, order: str, first: int = 0) -> DataFrame:
    """docs with offset, the number of documents before each by order, from first on; order must be unique and not null. Only (order) is sorted."""
    return docs.join(numbered_rows(docs.select(order), order, first=first), order)


def numbered_rows(rows: DataFrame, *order: str, first: int = 0) -> DataFrame:
    """rows with offset, the number of rows before each by order, from first on. Whole rows are sorted, so they should be short, and order may repeat or be null.

    They are sorted by ranges of the first of order over all tasks; a range's first number follows from the counts of those before it.
    """
    laid = written(rows.repartitionByRange(order[0]).sortWithinPartitions(*order).select(*rows.columns, F.monotonically_increasing_id().alias("at")), "numbered")
    part = F.shiftright("at", 33)  # the partition's number; below it stands the row's place
    ranges = laid.groupBy(part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return laid.join(F.broadcast(ranges.select("part", (before - F.col("low")).alias("shift"))), part == F.col("part")).select(*rows.columns, (F.col("at") + F.col("shift") + first).alias("offset"))
