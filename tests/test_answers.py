import json

import pytest
from pyspark.sql import functions as F

from gaugeworks import __main__ as cli
from gaugeworks.functions import answers, families, text
from gaugeworks.operators import requests as R
from gaugeworks.operators import results
from gaugeworks.plans import catalog
from gaugeworks.plans.evaluate import Metric, Task, evaluate, with_options
from gaugeworks.queries import length_scorer
from gaugeworks.sources import cache


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(*xs):
    return F.array(*map(F.lit, xs))


def test_language_normal(spark):
    cases = [("The “Cat”, a dog!", "en", "cat dog"), ("La casa y EL perro.", "es", "casa y perro"), ("der Hund, eine Öffnung", "de", "hund öffnung"), ("البيت", "ar", "بيت"), ("中国ab 人", "zh", "中 国 ab 人"), ("the", "hi", "the")]
    got = one(spark, *[answers.language_normal(F.lit(c), lang).alias(str(i)) for i, (c, lang, _) in enumerate(cases)])
    assert list(got) == [want for *_, want in cases]
    with pytest.raises(ValueError):
        answers.language_normal(F.lit("x"), "xx")


def test_contrast_passes_nan_over(spark):
    x = one(spark, answers.contrast(lit(0.2, float("nan"), 0.5), lit(0.4, float("nan"))).alias("x")).x
    assert (x.best, round(x.difference, 6), x.acc) == (0.5, 0.1, 1.0)


def test_conversation_leaves_out_equal_golds(spark):
    x = one(spark, answers.distinct_golds(lit("Yes", "no", "YES", "No", "maybe")).alias("g"), answers.conversation_answer(F.lit("yes\nor no"), lit("Yes", "yes")).alias("x"))
    assert x.g == ["Yes", "no", "maybe"] and tuple(x.x) == (1.0, 1.0)


def test_smoothed_bleu(spark):
    same, none, empty = one(spark, *[answers.smoothed_bleu(F.lit(p), F.lit(r)).alias(n) for n, p, r in (("a", "Returns the foo_bar.", "returns the foo_bar ."), ("b", "zzz", "a b c"), ("c", "", "a"))])
    # equal texts of 6 tokens: brevity 0, every order whole; empty prediction: exp(1 - 2)
    assert same == pytest.approx(100) and none < 1e-6 and empty == pytest.approx(100 * 2.718281828459045**-1)


def test_option_named(spark):
    options = lit("Red car", "Blue bus")
    got = one(spark, *[answers.option_named(F.lit(s), options).alias(str(i)) for i, s in enumerate(["(A) or (B)?", "B", "it is A, not B", "Apple", "I would rather take the red car today", ""])])
    assert list(got) == ["B", "B", "B", None, "A", None]
    drawn = one(spark, answers.option_named(F.lit("?"), options, F.lit(7)).alias("x")).x
    assert drawn in ("A", "B")


def test_percent_table_rounds_as_python(spark):
    rows = [("t", "acc", 0.40625, None), ("t", "ppl", 12.345, 1.0), ("squad2", "f1", 71.125, 0.5)]
    got = results.percent_table(spark.createDataFrame(rows, "task string, metric string, value double, stderr double")).collect()
    assert [tuple(r)[2:] for r in got] == [("%.2f" % 40.625, ""), ("%.2f" % 12.345, "1.00"), ("%.2f" % 71.125, "0.50")]


def test_few_shot_chat_without_pool(spark):
    docs = spark.createDataFrame([(1, "q")], "doc_id long, text string")
    pool = spark.createDataFrame([], "doc_id long, text string, target string")
    for sampler in ("first_n", "default"):
        m = R.few_shot_chat(docs, pool, 2, sampler).first().messages
        assert [tuple(x) for x in m] == [("user", "q")]
        assert R.few_shot(docs, pool, 2, sampler).first().context == "q"


CONFIGS = {
    "arc": {"task": "arc", "repeats": 1, "tag": "science"},
    "arc_hard": {"task": "arc_hard", "tag": ["science"]},
    "all": {"group": "all", "task": ["arc", {"task": "arc", "repeats": 5}, "deep"], "num_fewshot": 2},
    "deep": {"group": "deep", "task": [{"task": "arc_hard", "num_fewshot": 0}]},
}


def test_expand_configs():
    got = catalog.expand_configs("all", CONFIGS)
    assert list(got) == ["arc", "arc-1", "arc_hard"]
    assert got["arc"]["num_fewshot"] == 2 and got["arc"]["repeats"] == 1
    assert got["arc-1"]["repeats"] == 5 and got["arc_hard"]["num_fewshot"] == 0
    assert list(catalog.expand_configs("science", CONFIGS, {"repeats": 3})) == ["arc", "arc_hard"]
    assert catalog.expand_configs("science", CONFIGS, {"repeats": 3})["arc"]["repeats"] == 3
    assert CONFIGS["arc"]["repeats"] == 1


def test_predict_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    task = Task("t", docs, "generate_until", F.col("text"), F.lit("b"), [Metric("acc", lambda: F.lit(1.0))])
    got = evaluate(spark, with_options([task], predict_only=True, repeats=2), length_scorer).collect()
    assert [(r.metric, r.value, r.n) for r in got] == [("bypass", 999.0, 2)]


def test_command_line(tmp_path, capsys):
    (tmp_path / "arc.yaml").write_text("task: arc\nrepeats: 1\n")
    cli.main(["list", "a*", "--tasks", str(tmp_path)])
    assert capsys.readouterr().out.split() == ["arc"]
    cli.main(["show", "arc", "--tasks", str(tmp_path), "--set", "repeats=4", "name=x"])
    assert json.loads(capsys.readouterr().out)["arc"] == {"task": "arc", "repeats": 4, "name": "x"}
    cli.main(["list", "contamination_1*"])
    assert capsys.readouterr().out.split() == ["contamination_13gram"]
    with pytest.raises(SystemExit):
        cli.main(["list", "no_such_query"])


def test_number_words():
    cases = {"two hundred and five": 205, "three million, twenty one thousand": 3021000, "sixteen": 16, "ninety nine": 99, "hundred": 100, "one trillion & two": 10**12 + 2, "zero": 0}
    assert {k: families.number_of_words(k) for k in cases} == cases


def test_rouge_lsum():
    one = [["the", "cat", "sat", "on", "the", "mat"]], [["the", "mat", "the", "cat", "sat"]]
    assert text._lsum_f1(*one) == pytest.approx(text._lcs_f1(one[0][0], one[1][0])) == pytest.approx(6 / 11)
    # the two lines of the prediction together cover the reference's line; w1 counts once
    assert text._lsum_f1([["w1", "w2", "w6"], ["w1", "w3", "w5"]], [["w1", "w2", "w3", "w4", "w5"]]) == pytest.approx(2 * 4 / 11)
    assert text._lsum_f1([[]], [["a"]]) == text._lsum_f1([["b"]], [["a"]]) == 0.0


def test_cached_tables(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    at = str(tmp_path)
    for config in ({"task": "a", "n": 13}, {"n": 13, "task": "a"}, {"task": "b", "n": 13}):
        assert cache.cached(spark, at, "overlap", config, make).count() == 3
    assert len(made) == 2
    cache.cached(spark, at, "overlap-set", {}, make, rewrite=True)
    assert len(cache.forget(spark, at, "overlap")) == 2 and len(cache.forget(spark, at)) == 1
    assert cache.forget(spark, at + "/none") == []
