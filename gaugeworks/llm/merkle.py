"""Merkle manifest of a table: ordered leaves in fixed blocks, whose levels higher-order functions collapse; block roots are the leaves of the next round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Nodes of a run, and the leaves of a block: three levels.
FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
#: monotonically_increasing_id() holds the partition above this bit, and the row's place in it below.
PLACE_BITS = 33


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(*columns: Column) -> Column:
    """Digest of a row's values: each as its length in UTF-8 bytes, a colon and the value, or a hyphen for null."""
    shown = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]))


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its path (array of left and right, the siblings' digests of a level) lead to."""
    return F.aggregate(path, node, lambda at, x: digest(F.concat(x["left"], at, x["right"])))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (g, node, kept) with pos, the place in g by order, and size, the rows of g.

    Rows are sorted by ranges over all tasks and written, so that a large group is no single task's; places follow from
    each range's first row and the rows of g before it. Rows alike in order, which only equal leaves are, are split at will.
    """
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    sort = ["g", *order, "tie"]
    laid = materialize(tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("at", PLACE_BITS)
    ranges = laid.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    out = materialize(laid.withColumn("part", part).join(ranges, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"), "merkle-numbered")
    discard(laid)
    return out


def _levels(nodes: Column, height: Column) -> Column:
    """nodes and the levels above them, each level's runs of FAN collapsed to one digest."""

    def up(level):
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, FAN), "")))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(up(F.element_at(acc, -1)))))


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Written rounds of blocks (g, block, size, items, levels), and (g, node, round): each group's root and its last round.

    nodes are (g, pos, size, node) and in the first round kept. Every round leaves one node of a block, so there are as many as BLOCK has powers in the largest group.
    """
    rounds, roots = [], None
    depth = F.when(F.col("size") > 1, F.length(F.hex(F.col("size") - 1))).otherwise(0)  # a hexadecimal digit a level, as FAN is 16
    while True:
        block = F.floor(F.col("pos") / BLOCK).cast("long")
        rows = F.collect_list(F.struct(*[c for c in nodes.columns if c not in ("g", "size")]))
        by_place = lambda a, b: (a["pos"] - b["pos"]).cast("int")  # noqa: E731  kept may hold what has no order
        held = nodes.groupBy("g", "size", block.alias("block")).agg(F.array_sort(rows, by_place).alias("items"))
        now = materialize(held.withColumn("levels", _levels(F.col("items.node"), F.least(depth, F.lit(HEIGHT)).cast("int"))), "merkle-blocks")
        rounds.append(now)
        top = now.select("g", "size", "block", F.element_at(F.element_at("levels", -1), 1).alias("node"))
        last = top.where(F.col("size") <= BLOCK).select("g", "node", F.lit(len(rounds) - 1).alias("round"))
        roots = last if roots is None else roots.unionByName(last)
        nodes = top.where(F.col("size") > BLOCK).select("g", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), "node")
        if nodes.isEmpty():
            return rounds, roots


def _paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of the first round (g, pos, node, kept) with path and what tops (g, round, up, ...) hold of their group: each block's own siblings go before the path of its root."""
    shared = [c for c in tops.columns if c not in ("g", "round", "up")]
    below = None
    for r in range(len(rounds) - 1, -1, -1):
        above = tops.where(F.col("round") == r).select("g", F.lit(0).cast("long").alias("block"), "up", *shared)
        if below is not None:
            above = above.unionByName(below)
        # First runs of FAN leave their block, each with the path of the node above it, then leaves their run: no row carries a whole block.
        def beside(level, at):
            first = at - at % FAN
            return F.struct(F.array_join(F.slice(level, first + 1, at - first), "").alias("left"), F.array_join(F.slice(level, at + 2, first + FAN - 1 - at), "").alias("right"))

        higher = F.slice("levels", F.lit(2), F.greatest(F.size("levels") - 2, F.lit(0)))
        above_run = lambda i: F.transform(higher, lambda level, j: beside(level, F.call_function("shiftright", i, j * 4)))  # noqa: E731  FAN is 16, four bits
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / FAN).cast("int")), lambda i: F.struct(F.slice("items", i * FAN + 1, FAN).alias("items"), above_run(i).alias("path")))
        one = rounds[r].join(above, ["g", "block"]).select("g", (F.size("levels") > 1).alias("run"), "up", *shared, F.explode(runs).alias("x"))
        one = one.select("g", "run", F.concat("x.path", "up").alias("up"), *shared, F.col("x.items.node").alias("nodes"), F.posexplode("x.items").alias("i", "item"))
        path = F.when(F.col("run"), F.concat(F.array(beside(F.col("nodes"), F.col("i"))), "up")).otherwise(F.col("up"))
        one = one.select("g", "item.*", path.alias("path"), *shared)
        if r == 0:
            return one
        below = materialize(one.select("g", F.col("pos").alias("block"), F.col("path").alias("up"), *shared), "merkle-paths")


def prove(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf, ...) with pos, path, subroot and root, for every row; these take the place of columns so named.

    Leaves of a source ascend by doc_id, null first, then by digest; rows alike in all three are interchangeable. Runs of 16 nodes (the last: fewer)
    become one until one is left: the subroot, a lone leaf itself. Subroots by source (null first, else by bytes) become the root likewise. path holds the digests
    left and right of the leaf's own node, level by level to the root; fold(leaf, path) is the root. An empty table gives no rows.
    """
    keep = [c for c in leaves.columns if c not in ("pos", "path", "subroot", "root")]
    narrow = leaves.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"), F.col("leaf").alias("node"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    narrow = materialize(narrow, "merkle-leaves")  # before the sort, which would work the digests out twice
    nodes = _numbered(narrow, "kept.doc_id", "node")
    rounds, roots = _rounds(nodes)
    discard(narrow, nodes)
    sources = _numbered(roots.select(F.lit("").alias("g"), "node", F.struct(F.col("g").alias("name"), F.col("round").alias("last")).alias("kept")), "kept.name")
    upper, root = _rounds(sources)
    tops = _paths(upper, root.select("g", "round", F.array().cast("array<struct<left:string,right:string>>").alias("up"), F.col("node").alias("root")))
    tops = materialize(tops.select(F.col("kept.name").alias("g"), F.col("kept.last").alias("round"), F.col("path").alias("up"), F.col("node").alias("subroot"), "root"), "merkle-tops")
    discard(sources)
    return _paths(rounds, tops).select("kept.*", "pos", "path", "subroot", "root")
