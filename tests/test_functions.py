import math
import random

from pyspark.sql import functions as F

from gaugeworks import queries
from gaugeworks.functions import filters, metrics, text, translation
from gaugeworks.functions.bootstrap import bootstrap_stderr
from gaugeworks.functions.stats import pooled_stderr
from gaugeworks.operators import corpus, requests
from gaugeworks.plans.catalog import template
from gaugeworks.plans.evaluate import task_results


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first().x


def test_strip_and_words_follow_python(spark):
    s = "\x1c  a  b c \x1f\n"
    assert one(spark, text.strip(F.col("s")), s=s) == s.strip()
    assert one(spark, text.words(F.col("s")), s=s) == s.split()


def test_ngrams(spark):
    s = "Hello my name is Bob, I like eating pineapple"
    for n in (1, 2, 3, 5, 13):
        w = s.split()
        assert one(spark, text.ngrams(text.words(F.col("s")), n), s=s) == [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_token_f1_and_rouge(spark):
    a, b = F.split("a", " "), F.split("b", " ")
    assert math.isclose(one(spark, text.token_f1(a, b), a="x x y", b="x y y"), 2 / 3)
    assert one(spark, text.token_f1(a, b), a="x", b="y") == 0
    assert math.isclose(one(spark, text.rouge_l(a, b), a="p q r s", b="p r s t u"), 2 * 3 / 9)


def test_filters(spark):
    t = F.array(F.col("s"))
    assert one(spark, filters.regex(r"#### (\-?[0-9\.\,]+)")(t)[0], s="so #### 42 and #### 43") == "42"
    assert one(spark, filters.regex(r"(\d+)|([a-z]+)!", -1)(t)[0], s="12 ab!") == "ab"
    assert one(spark, filters.regex(r"\d+")(t)[0], s="none") == "[invalid]"
    votes = F.split("s", ",")
    assert one(spark, filters.majority_vote()(votes), s="b,a,a,b,c") == ["b"]
    assert one(spark, filters.format_span()(t)[0], s="person: Ann, none$$place: x") == "per: ann"
    pick = filters.multi_choice_regex(F.array(F.lit("red"), F.lit("blue")), r"\(([A-D])\)")
    assert one(spark, pick(t)[0], s="it is blue") == "(B)" and one(spark, pick(t)[0], s="answer: A") == "(A)"


def test_argmax_takes_the_first_of_equals(spark):
    v = F.array(F.lit(-2.0), F.lit(-1.0), F.lit(-1.0))
    assert one(spark, metrics.argmax(v), s=1) == 1
    u = F.array(F.lit(-2.0), F.lit(-2.0), F.lit(-3.0))
    assert one(spark, metrics.acc_mutual_info(v, u, F.lit(2)), s=1) == 1.0


def test_rolling_windows_goldens(spark):
    w = one(spark, requests.rolling_windows(F.sequence(F.lit(0), F.lit(33)), F.lit(-100), 10, 1), s=1)
    assert [(x.input, x.predicted) for x in w] == [([-100, *range(9)], [*range(10)]), ([*range(9, 19)], [*range(10, 20)]), ([*range(19, 29)], [*range(20, 30)]), ([*range(23, 33)], [*range(30, 34)])]
    assert one(spark, requests.rolling_windows(F.array().cast("array<int>"), F.lit(-100), 10), s=1) == []
    d = one(spark, F.transform(requests.rolling_windows(F.sequence(F.lit(0), F.lit(33)), F.lit(-100), 10, 1), requests.disjoint), s=1)
    assert [(x.input, x.predicted) for x in d][-1] == ([*range(23, 30)], [*range(30, 34)])


def test_cleaning(spark):
    filth = "filth lies here now"
    body = "x" * 300 + " " + filth + " " + "y" * 500
    docs = spark.createDataFrame([(1, body), (2, "short"), (3, (filth + " ") * 20)], "doc_id long, text string")
    dirt = spark.createDataFrame([(filth,)], "text string")
    got = {r.doc_id: r.chunks for r in corpus.clean(docs, dirt, 4, window=20).collect()}
    at = body.index(filth)
    assert got[1] == [body[: at - 20], body[at + len(filth) - 1 + 20 + 1 :]] and got[2] == [] and got[3] == []


def test_errors(spark):
    a, b = [1.0] * 40 + [0.0] * 20, [1.0] * 30
    rows = spark.createDataFrame([(t, i, v) for t, x in (("a", a), ("b", b)) for i, v in enumerate(x)], "task string, doc_id long, v double")
    parts = rows.groupBy("task").agg(metrics.stderr().alias("stderr"), F.count("v").alias("n"))
    whole = rows.agg(metrics.stderr().alias("s")).first().s
    assert abs(parts.agg(pooled_stderr().alias("s")).first().s - whole) < 5e-3
    boot = {r.task: r.stderr for r in bootstrap_stderr(rows, ["task"], 300).collect()}
    assert abs(boot["a"] - parts.where("task = 'a'").first().stderr) < 0.015 and boot["b"] == 0


def test_bootstrap_is_of_the_metric(spark):
    r = random.Random(2)
    values = [(m, i, r.gauss(-3, 0.5)) for m in ("ppl", "med") for i in range(300)] + [("nan", i, 1.0 * (i % 2) if i % 3 else float("nan")) for i in range(300)]
    rows = spark.createDataFrame(values, "metric string, doc_id long, v double").selectExpr("'t' AS task", "'none' AS filter", "*")
    how = {"ppl": "perplexity", "med": "median", "nan": "nanmean"}
    got = {x.metric: x for x in task_results(rows, how, 200).collect()}
    ppl = [v for m, _, v in values if m == "ppl"]
    mean = sum(ppl) / len(ppl)
    want = math.exp(-mean) * math.sqrt(sum((v - mean) ** 2 for v in ppl) / len(ppl) ** 2)  # delta method
    assert abs(got["ppl"].stderr / want - 1) < 0.25
    assert abs(got["nan"].stderr - 0.5 / math.sqrt(200)) < 0.01
    med, spread = [v for m, _, v in values if m == "med"], []
    for _ in range(400):  # the value at the middle place of a resample in order of doc_id
        spread.append(med[sorted(r.choices(range(300), k=300))[150]])
    middle = sum(spread) / 400
    assert abs(got["med"].stderr / math.sqrt(sum((x - middle) ** 2 for x in spread) / 399) - 1) < 0.35


def test_translation_bounds(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c d", "e f g h"), (3, "b c d a", "a b c d")], "k int, pred string, ref string")
    assert {r.k: round(r.bleu) for r in translation.bleu(df, ["k"]).collect()} == {1: 100, 2: 0, 3: 0}
    chrf = {r.k: r.chrf for r in translation.chrf(df, ["k"]).collect()}
    assert round(chrf[1]) == 100 and chrf[2] == 0 and 0 < chrf[3] < 100
    assert {r.k: r.ter for r in translation.ter(df, ["k"]).collect()} == {1: 0.0, 2: 100.0, 3: 25.0}


def test_ter_takes_whole_texts(spark):
    def plain(hyp, ref):
        shifts, now = 0, translation._edits(hyp, ref)
        while True:
            best = None
            for k in range(1, min(10, len(hyp)) + 1):
                blocks = {tuple(ref[j : j + k]) for j in range(len(ref) - k + 1)}
                for i in range(len(hyp) - k + 1):
                    rest = hyp[:i] + hyp[i + k :]
                    for j in range(len(rest) + 1):
                        if tuple(hyp[i : i + k]) in blocks and j != i:
                            moved = rest[:j] + hyp[i : i + k] + rest[j:]
                            e = translation._edits(moved, ref)
                            if e + 1 < now and (best is None or e < best[0]):
                                best = (e, moved)
            if best is None:
                return shifts + now
            now, hyp = best
            shifts += 1

    r = random.Random(4)
    for _ in range(60):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 11))] for _ in range(2))
        assert translation.ter_edits(a, b) == plain(a, b)
    same = " ".join(f"w{i}" for i in range(30))
    turns = spark.createDataFrame([(1, 0, same + " x y"), (1, 1, same + " v z")], "conv_id long, turn int, text string")
    got = queries.QUERIES["translation_edit_rate"].__closure__
    f = next(c.cell_contents for c in got if callable(c.cell_contents))
    assert [round(x.ter, 6) for x in f(lambda name: turns).collect()] == [6.25]


def test_template(spark):
    c = template("Q: {{q.strip()}}\nA: {{a|upper}}", ["q", "a"])
    assert one(spark, c, q="  why ", a="so") == "Q: why\nA: SO"


def test_latex_normal():
    from gaugeworks.functions.families import latex_normal as f

    assert f("k = \\dfrac12") == "\\frac{1}{2}" and f("\\frac1{72}") == "\\frac{1}{72}" and f("\\frac{3}{4}") == "\\frac{3}{4}"
    assert f("0.5") == f("1/2") == f(".5") == "\\frac{1}{2}" and f("07/3") == "07/3" and f("\\sqrt3 \\text{ cm}") == "\\sqrt{3}"
    assert f("\\left(x\\right)^{\\circ}") == "(x)" and f("10\\%") == "10" and f("x=y=2") == "x=y=2" and f("") == "" and f("1\\text{ a}\\text{ b}") is None
    assert f("\\frac") == "\\frac"


def test_needles_and_paragraphs(spark):
    from pyspark.sql import functions as F

    from gaugeworks.functions import families

    u = "01234567-89ab-cdef-0123-456789abcdef"
    rows = [("it is 1 234 567.", ["7654321"], "1234567"), (f"see {u}!", [u], u), ("1-23-4567", ["7654321"], "1234567"), ("none", ["7654321"], "none"), ("1234567", ["x"], "1234567"), (" a\x01b ", [], "a\nb")]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "r string, o array<string>")
    assert [x[0] for x in df.select(families.needles(F.col("r"), F.col("o"))).collect()] == [c for _, _, c in rows]
    p = spark.createDataFrame([("Paragraph 3 and paragraph12", [3, 12]), ("the 7th of 9", [7]), ("none", [])], "t string, n array<long>")
    assert all(x.n == x.got for x in p.select("n", families.paragraph_numbers(F.col("t")).alias("got")).collect())


def test_classes_found_passes_over_the_one_after_a_removed_class():
    from gaugeworks.functions.families import classes_found

    assert classes_found("sport and sports news", "sports", ["sport", "port", "sports"]) == 0.5
    assert classes_found("a b", "c", ["a", "b"]) == 0.0


def test_cache_keys_repeats_and_contaminated_beyond_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gaugeworks.operators import corpus
    from gaugeworks.plans.evaluate import Metric, Task, cached_or_scored, requests

    d = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    task = Task("t", d, "generate_until", F.col("text"), F.col("text"), [Metric("m", lambda: F.lit(1.0))], repeats=2)
    asked = requests(task)

    def scorer(batches):
        for b in batches:
            b["ll"], b["is_greedy"], b["text"] = 0.0, True, "fresh"
            yield b

    cache = asked.where("doc_id = 1").select("req_hash", "rep", F.lit(-1.0).alias("ll"), F.lit(True).alias("is_greedy"), F.lit("kept").alias("text"))
    got = cached_or_scored(asked, scorer, cache.union(cache)).collect()
    assert sorted((r.doc_id, r.rep, r.text) for r in got) == [(1, 0, "kept"), (1, 1, "kept"), (2, 0, "fresh"), (2, 1, "fresh")]
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(30))) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(20))), (1, "nothing here")], "item_id long, text string")
    out = []
    for most in (2_000_000, 0):
        monkeypatch.setattr(corpus, "BROADCAST_GRAMS", most)
        out.append((sorted(r.doc_id for r in corpus.contaminated(docs, items, 5, "doc_id", "item_id").collect()), [r.item_id for r in corpus.contaminated(items, docs, 5, "item_id", "doc_id").collect()], sorted(map(tuple, corpus.document_frequency(docs, 4, 3).collect()))))
    assert out[0] == out[1] and 0 < len(out[0][0]) < 60 and out[0][1] == [0] and out[0][2]


def test_few_shot_from_an_empty_pool_keeps_every_document(spark):
    from gaugeworks.operators.requests import few_shot

    d = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "doc_id long, text string, target string")
    assert sorted(map(tuple, few_shot(d, d.limit(0), 2, "default").collect())) == [(1, "a"), (2, "c")]
    assert few_shot(d, d, 3, "default").count() == 2
