from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import line_dedup, mixing, quality, simhash
from gaugeworks.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_their_operators_and_keep_the_columns(spark):
    docs = table(spark, SF, "documents").cache()
    labels = table(spark, SF, "labels")
    columns = docs.columns
    kept = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    a = corpus_pipeline.keep_good(spark, docs, SF).cache()
    assert a.columns == columns and {r.doc_id for r in a.select("doc_id").collect()} == kept
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(good - kept) <= 0.02 * len(good)
    b = corpus_pipeline.drop_lines(spark, a, SF).cache()
    assert b.columns == columns and b.count() == a.count() and b.where(F.length("text") != F.col("n_chars")).count() == 0
    c = corpus_pipeline.drop_near_duplicates(spark, b, SF).cache()
    names = {r.component_id for r in simhash.near_duplicates(b).collect()}
    assert c.columns == columns and {r.doc_id for r in c.select("doc_id").collect()} == names and c.count() == len(names)
    d = corpus_pipeline.mix(spark, c, SF)
    copies = {r.doc_id: r.mix_copies for r in mixing.sizes_mixed(c).collect()}
    assert d.columns == columns and {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where("NOT round_trip").count() == 0 and out.count() > 0
