"""A corpus pipeline of five stages; part of the subpackage gaugeworks.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import line_dedup, mixing, pieces, quality, simhash
from gaugeworks.llm.common import materialize, table
from gaugeworks.llm.queries import TOKENIZER

#: SimHash, sampling and hashing have no SQL; tests hold line dedup and near-duplicates against plain versions, and the other stages against their operators, which have tests of their own.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, each row by itself. A null or empty text is judged by its source and language alone; without labels all stay; an empty table gives no rows."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their host go; n_chars follows the text. Null texts stay null, rows left without a line stay with an empty text, null sources are one host; repeated rows each count as a page."""
    out = line_dedup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id; ties by text, then by the other columns. Null and empty texts are one group; rows without doc_id are reduced to one a group by themselves."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn twice or thrice come as often; those drawn not at all go. Null sources are one source, the last; a text without words is of size 0 and may come along with its block; an empty table gives no rows."""
    return mixing.drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row; copies of a document have the same ones. A null or empty text has one. An empty table gives no rows."""
    return pieces.sample(docs, TOKENIZER)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_lines), ("near-duplicates", drop_near_duplicates), ("mixing", mix), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row on documents; each is written to the shared scratch folder, so a lost executor never sets the work back beyond its stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
