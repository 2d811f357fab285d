import itertools
import math
import random

from pyspark.sql import functions as F

from gaugeworks.functions import scoring


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


def test_spans_match_best(spark):
    r = random.Random(3)
    words = ["red", "blue", "7", "green house", "the red", "8 7"]
    for _ in range(60):
        p, g = ([r.choice(words) for _ in range(r.randint(1, 4))] for _ in range(2))
        a, b = [scoring._bag(s) for s in p], [scoring._bag(s) for s in g]
        size = max(len(a), len(b))
        a, b = a + [None] * (size - len(a)), b + [None] * (size - len(b))
        best = max(sum(scoring._bag_f1(x, y) for x, y in zip(a, o) if x is not None and y is not None) for o in itertools.permutations(b))
        assert math.isclose(scoring.span_scores(p, g)[1], round(best / size, 2))
    assert scoring.span_scores(["The 7.0"], ["7"]) == (1.0, 1.0)
    assert scoring.span_scores(["8 dogs"], ["7 dogs"]) == (0.0, 0.0)
    assert scoring.span_scores([], []) == (1.0, 0.0)
    got = one(spark, scoring.spans_exact_f1(F.col("p"), F.col("g")), "p array<string>, g array<array<string>>", ["x"], [["y"], ["x"]])
    assert (got.exact, got.f1) == (1.0, 1.0)


def test_instructions(spark):
    ok = lambda t, n, loose=False, **k: scoring.follows(t, n, k, loose)
    assert ok("no commas here", "punctuation:no_comma") and not ok("a, b", "punctuation:no_comma")
    assert ok("one *** two", "length_constraints:number_paragraphs", num_paragraphs=2) and not ok("one *** *** two", "length_constraints:number_paragraphs", num_paragraphs=3)
    assert ok("x\n\nHello, you", "length_constraints:nth_paragraph_first_word", num_paragraphs=2, nth_paragraph=2, first_word="hello")
    assert ok("* a\n- b", "detectable_format:number_bullet_lists", num_bullets=2)
    assert ok("```json\n{}\n```", "detectable_format:json_format") and not ok("{", "detectable_format:json_format")
    assert ok("a ****** b", "combination:two_responses") and not ok("a ****** a", "combination:two_responses")
    assert ok("so. P.S. bye", "detectable_content:postscript", postscript_marker="P.S.")
    assert ok("Sure!\nabc", "change_case:english_lowercase", True) and not ok("Sure!\nabc", "change_case:english_lowercase")
    assert ok("x", "language:response_language") is None and ok(" ", "punctuation:no_comma") is False
    c = scoring.instructions_followed(F.col("t"), F.col("n"), F.col("a"))
    df = spark.createDataFrame([("k", "a b", ["punctuation:no_comma", "startend:quotation"], ["{}", None]), ("k", '"a"', ["startend:quotation"], ["{}"])], "k string, t string, n array<string>, a array<string>")
    assert scoring.instruction_accuracy(df.withColumn("followed", c), ["k"]).first()[1:] == (0.5, 2 / 3)


def test_expressions(spark):
    assert one(spark, scoring.boxed(F.col("s")), "s string", r"\boxed{1} and \boxed{\frac{1}{2}}.") == r"\frac{1}{2}"
    assert one(spark, scoring.boxed(F.col("s")), "s string", r"\boxed{1") is None
    for p, g, x in [("10.4", "10", 1.0), ("11", "10", 0.0), ("50%", "0.5", 1.0), ("Yes", "yes", 1.0), ("0", "0", 1.0)]:
        assert one(spark, scoring.relaxed_accuracy(F.col("p"), F.col("g")), "p string, g string", p, g) == x
    for n, c, k in [(10, 0, 3), (10, 2, 3), (10, 9, 3), (5, 5, 5)]:
        assert math.isclose(one(spark, scoring.pass_at_k(F.col("n"), F.col("c"), k), "n int, c int", n, c), 1 - math.comb(n - c, k) / math.comb(n, k), abs_tol=1e-12)
    assert one(spark, scoring.f1_or_equal(F.col("a"), F.col("b")), "a array<string>, b array<string>", [], []) == 1.0
    for j, ok in [("{", 0.0), ("", 0.0), ("1 2", 0.0), ("1, 2", 0.0), ("1] [2", 0.0), ('"k": 1}', 0.0), ("[1, 2]", 1.0), ('{"k": {}}', 1.0)]:
        assert one(spark, scoring.valid_json(F.col("s")), "s string", j) == ok
    assert math.isclose(one(spark, scoring.log_sum_exp(F.col("v")), "v array<double>", [-1000.0, -1000.0]), -1000 + math.log(2))
    r = one(spark, scoring.ranks(F.col("v"), F.col("g")), "v array<double>, g int", [-1.0, -3.0, -2.0], 2)
    assert (r.r1, r.r2, r.mrr) == (0.0, 1.0, 0.5)


def test_best_threshold_follows_a_sweep(spark):
    r = random.Random(5)
    rows = [("k", i / 40, bool(r.randint(0, 1)), bool(r.randint(0, 1)), r.random()) for i in range(40)]
    now = best = sum(not h for _, _, h, _, _ in rows)
    at = 0.0
    for _, p, has, answered, score in rows:
        now += score if has else -float(answered)
        if now > best + 1e-12:
            best, at = now, p
    got = scoring.best_threshold(spark.createDataFrame(rows, "k string, p double, has_answer boolean, answered boolean, score double"), ["k"]).first()
    assert math.isclose(got.best, best / 40) and got.threshold == at
