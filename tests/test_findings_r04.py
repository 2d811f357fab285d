"""What the fourth round's findings showed: each would have failed before."""

import random

from pyspark.sql import functions as F

from gaugeworks import queries
from gaugeworks.functions import similarity
from gaugeworks.operators import corpus, sentences


def test_last_pages_are_compared_with_the_first(spark, tmp_path):
    """Every page meets the two after it: over the end of the table, and over ids that are missing."""
    lines = {0: "alpha = 1", 1: "beta()", 4: "alpha = 2", 5: "gamma(beta)", 9: "# none", 11: "beta(1)"}
    rows = [(k, f"# head\n{v}") for k, v in lines.items()] + [(None, "alpha = 3")]
    spark.createDataFrame(rows, "page_id long, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    each = [(None, "alpha = 3"), *((k, "" if v[0] == "#" else v) for k, v in lines.items())]
    want = {k: similarity.best_ratio(line, [each[(i + j) % len(each)][1] for j in (1, 2)]) for i, (k, line) in enumerate(each)}
    assert want[11] > 0 and want[4] > 0
    got = queries.queries()["code_line_similarity"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and dict(got) == want


def test_what_goes_through_the_driver_is_bounded(spark, monkeypatch):
    """Beyond what a filter may hold, hashes that no document has are taken out before it is made."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 40 + k}" for k in range(40))) for i in range(50)] + [(50, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(" ".join(f"v{i * 40 + k}" for k in range(40)),) for i in range(500)] + [("w3 w4, W5 w6 w7",), (None,)], "text string")
    monkeypatch.setattr(corpus, "MAX_FILTER", 1024)  # 682 hashes
    made = []
    monkeypatch.setattr(corpus, "gram_filter", lambda hashes, about, *probes, f=corpus.gram_filter: made.append(about) or f(hashes, about, *probes))
    for most, filters in ((None, 0), (100, 1), (0, 2)):
        monkeypatch.setattr(corpus, "BROADCAST_GRAMS", 500_000 if most is None else most)
        made.clear()
        side, blocks = corpus.asked_side(asked, docs, 3)
        assert len(made) == filters and (blocks or 0) * 256 <= 1024
        if most is not None:
            assert made[1:] in ([], [3]) and (blocks is not None or side.count() == 3)
        got = {tuple(x) for x in corpus.met_grams(docs, "doc_id", 3, side, blocks).collect()}
        assert got >= {(0, "w3 w4 w5"), (0, "w4 w5 w6"), (0, "w5 w6 w7")} and len(got) < 60
    own, other = corpus.shared_grams(docs, asked.withColumn("item_id", F.lit(7)), 3, "doc_id", "item_id", broadcast_grams=0)
    assert sorted(x.ngram for x in own.join(other, "ngram").collect()) == ["w3 w4 w5", "w4 w5 w6", "w5 w6 w7"]


def test_only_forms_that_decide_are_counted(spark):
    """For "at least" only the whole text counts, with and without asterisks; and only words that may end a sentence, and the last, become rows."""
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["Dr. ", "x. ", "5. ", "The ", "He ", "word ", "stop. ", "why? ", "no! ", "*no.* ", "stop.* ", "* ", "\n"]) for _ in range(r.randrange(60)))) for i in range(150)] + [(150, None), (151, " \n*"), (None, "One. Two. Three. Four. Five.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = sentences.Model(spark.createDataFrame([("dr",)], "word string"), spark.createDataFrame([("the",)], "word string"))
    assert sentences._ends(d.where("doc_id IS NULL"), "doc_id", "text").count() == 5
    assert sentences._ends(spark.createDataFrame([(1, "one two three. four five")], "doc_id long, text string"), "doc_id", "text").count() == 2
    every = d.select("doc_id", F.posexplode(sentences.response_forms(F.col("text"), True)).alias("i", "form")).select(F.struct("doc_id", "i").alias("id"), "form")
    n = {}
    for x in sentences.sentence_counts(every, "id", model, "form").collect():
        n.setdefault(x.id.doc_id, {})[x.id.i] = x.sentences
    for relation in ("at least", "less than"):
        holds = (lambda s: s >= 5) if relation == "at least" else (lambda s: s < 5)
        want = sorted((repr(k), 0 in n.get(k, {}) and holds(n[k][0]), any(map(holds, n.get(k, {}).values()))) for k, _ in rows)
        both = sentences.enough_sentences_both(d, "doc_id", F.lit(5), F.lit(relation), model)
        assert sorted((repr(x.doc_id), x.strict, x.loose) for x in both.collect()) == want
        assert any(x[1] != x[2] for x in want)
