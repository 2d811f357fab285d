"""A bucketed store of a corpus' n-grams: filled part by part, then joined with any number of others, or counted, without shuffling it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams, normalize, words
from ..sources.scratch import shared_folder
from .corpus import gram_side, met_grams, text_hash


class GramStore:
    """Rows (ngram, offset, part), distinct within a part and bucketed by n-gram; offset is the document's.

    Stores of equal buckets join bucket by bucket. Each part adds at most a file a bucket, sorted. A part is there once its marker is, which is written last and names the
    attempt: what a lost driver left half written is never read, and the same parts may be given again, as those that are there are passed over. A null text has no n-grams.
    All rows of an n-gram share a bucket: one that a third of all documents have makes that bucket's task long, though not its memory large, as rows stream by in order.
    """

    def __init__(self, spark: SparkSession, name: str, n: int, buckets: int = 64, folder: str | None = None):
        """A store in folder (the shared scratch folder, if none is named), new or filled before."""
        self.spark, self.name, self.n, self.buckets = spark, name, n, buckets
        self.path = f"{(folder or shared_folder(spark)).rstrip('/')}/{name}"
        self._markers = self._at(f"{self.path}-parts")
        self._fs = self._markers.getFileSystem(spark._jsc.hadoopConfiguration())
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` (ngram STRING, offset BIGINT, part STRING) USING parquet CLUSTERED BY (ngram) SORTED BY (ngram) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def parts(self) -> dict[str, str]:
        """Names of the parts that are there, and the attempt that wrote each."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._markers)] if self._fs.exists(self._markers) else []
        return {n.rpartition("@")[0]: n for n in sorted(names)}

    def append(self, docs: DataFrame, part: str, offset: str = "offset", text: str = "text", among: tuple[DataFrame, int | None] | None = None) -> bool:
        """Add the n-grams of docs (offset, text); False if the part is there. The one shuffle of these n-grams is here.

        among, a gram_side() of the n-grams that will be asked for, keeps the others (but for a share of false positives) from being moved and kept.
        """
        if part in self.parts():
            return False
        attempt = f"{part}@{uuid.uuid4().hex}"
        docs = docs.select(F.col(offset).cast("long").alias("offset"), F.col(text).alias("text"))
        if among is None:
            grams = docs.select(F.explode(F.array_distinct(ngrams(words(normalize(F.col("text"))), self.n))).alias("ngram"), "offset")
        else:
            grams = met_grams(docs, "offset", self.n, *among).select("ngram", "offset")
        # the write of a bucketed table sorts by itself
        grams.repartition(self.buckets, "ngram").withColumn("part", F.lit(attempt)).write.insertInto(self.name)
        self._fs.create(self._at(f"{self.path}-parts/{attempt}")).close()
        return True

    def rows(self) -> DataFrame:
        """The parts' rows, in their buckets."""
        there = self.parts()
        return self.spark.table(self.name).where(F.col("part").isin(list(there.values()))).withColumn("part", F.col("part").substr(F.lit(1), F.length("part") - 33))

    def gram_side(self) -> tuple[DataFrame, int | None]:
        """What texts meet that are asked for the n-grams that are there, as append() takes it."""
        hashes = self.rows().select(text_hash(self.n).alias("h"))
        return gram_side(hashes, hashes.agg(F.approx_count_distinct("h", 0.02)).first()[0])

    def matches(self, other: "GramStore") -> DataFrame:
        """(ngram, offset, part, other_offset, other_part): n-grams of both stores. With equal buckets both are read in place: no Exchange."""
        if (self.n, self.buckets) != (other.n, other.buckets):
            raise ValueError("stores must have n-grams of equal length and as many buckets")
        theirs = other.rows().select("ngram", F.col("offset").alias("other_offset"), F.col("part").alias("other_part"))
        return self.rows().hint("merge").join(theirs, "ngram")

    def frequent(self, more_than: int = 10) -> DataFrame:
        """(ngram, docs): n-grams of more than more_than documents, counted bucket by bucket."""
        return self.rows().groupBy("ngram").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > more_than)

    def drop(self) -> None:
        """Forget the store and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        for p in (self._at(self.path), self._markers):
            self._fs.delete(p, True)
