"""Site-relative line dedup: drop lines that stand on too large a share of their host's pages.

DataFrame functions only. A page counts a line once. Lines are compared without spaces, tabs
and carriage returns at their ends; blank lines are never counted nor dropped. A host cannot
have more boilerplate lines than its mean number of lines a page divided by the ratio, so
the table of hosts and their lines is small however many pages there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

RATIO, MIN_PAGES = 0.1, 5
HOSTS_BROADCAST, SALTS = 20_000, 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, bad): hashes of the lines on more than ratio of a host's pages, and at least min_pages. Null hosts are one host."""
    pages = docs.select(F.col("source").alias("host"), "text")
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _bare(x) != ""), lambda x: F.xxhash64(_bare(x))))
    seen = pages.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    bad = seen.alias("s").join(total.alias("t"), F.expr("s.host <=> t.host")).where(F.col("n") > ratio * F.col("pages"))
    return bad.groupBy("s.host").agg(F.array_sort(F.collect_list("h")).alias("bad"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with the boilerplate lines taken out of text, and n_lines and n_dropped (long) added.

    A null text stays null with no lines; an empty text has one empty line; a text of
    which every line goes becomes empty. Repeated rows each count as a page. Columns of docs that bear
    the added names are replaced; all others stay. An empty table gives no rows.
    """
    hosts = materialize(boilerplate(docs, ratio, min_pages), "boilerplate")
    side = small_side(hosts, HOSTS_BROADCAST)
    docs = docs.drop("n_lines", "n_dropped")
    if side is hosts:  # many hosts: deal the rows of a large one over several tasks
        side = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = docs.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).alias("d")
        joined = d.join(side.alias("h"), F.expr("d.source <=> h.host AND d.__salt = h.__salt"), "left")
    else:
        joined = docs.alias("d").join(side.alias("h"), F.expr("d.source <=> h.host"), "left")
    lines = _lines(F.col("d.text"))
    kept = F.when(F.col("h.bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("h.bad"), F.xxhash64(_bare(x))) | (_bare(x) == "")))
    count = lambda x: F.when(F.col("d.text").isNull(), 0).otherwise(x).cast("long")
    out = [F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*out, count(F.size(lines)).alias("n_lines"), count(F.size(lines) - F.size(kept)).alias("n_dropped"))
