"""Scores of answers: in several languages, against right and wrong references, of entities, conversations, lettered options and code comments."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, scoring, text, translation

# The articles that do not count, by language.
ARTICLES = {
    "en": ["a", "an", "the"],
    "es": ["un", "una", "unos", "unas", "el", "la", "los", "las"],
    "vi": ["của", "là", "cái", "chiếc", "những"],
    "de": ["ein", "eine", "einen", "einem", "eines", "einer", "der", "die", "das", "den", "dem", "des"],
}
ARABIC_ARTICLE = "ال"
NO_ARTICLES = ("hi", "zh")


def language_normal(c: Column, lang: str) -> Column:
    """Lower case without punctuation (Unicode's and ASCII's) and the language's articles, single blanks; every Han character is a word in Chinese."""
    bare = F.regexp_replace(F.lower(c), r"[\p{P}$+<=>^`|~]", "")
    if lang in ARTICLES:
        bare = F.regexp_replace(bare, rf"(?U)\b({'|'.join(ARTICLES[lang])})\b", " ")
    elif lang == "ar":
        bare = F.replace(bare, F.lit(ARABIC_ARTICLE), F.lit(" "))
    elif lang == "zh":
        bare = F.regexp_replace(bare, "([一-龥])", " $1 ")
    elif lang not in NO_ARTICLES:
        raise ValueError(f"unknown language {lang!r}")
    return F.array_join(text.words(bare), " ")


def language_answer(prediction: Column, golds: Column, lang: str) -> Column:
    """struct(exact, f1): the best over golds, all in the language's normal form."""

    def of(p, gs):
        exact = F.array_contains(gs, p).cast("double")
        return F.struct(exact.alias("exact"), text.best_of(gs, lambda g: text.token_f1(text.words(p), text.words(g))).alias("f1"))

    normal = lambda c: language_normal(c, lang)
    return text.let(normal(prediction), lambda p: text.let(F.transform(golds, normal), lambda gs: of(p, gs)))


def contrast(right: Column, wrong: Column) -> Column:
    """struct(best, difference, acc) of scores against right and wrong references: the best right one, how far it lies over the best wrong one, and whether it does. NaN never counts."""
    top = lambda s: F.array_max(F.filter(s, lambda x: ~F.isnan(x)))
    return text.let(top(right), lambda a: text.let(top(wrong), lambda b: F.struct(a.alias("best"), (a - b).alias("difference"), (a > b).cast("double").alias("acc"))))


def _squad(p: Column, g: Column) -> Column:
    words = lambda c: text.words(text.answer_normal(c))
    return scoring.f1_or_equal(words(p), words(g))


def entity_answer(lls: Column, entities: Column, answers: Column) -> Column:
    """struct(em, f1): the likeliest entity against the best answer, in QA normal form."""

    def of(p):
        same = text.best_of(answers, lambda a: (text.answer_normal(a) == text.answer_normal(p)).cast("double"))
        return F.struct(same.alias("em"), text.best_of(answers, lambda a: _squad(p, a)).alias("f1"))

    return text.let(F.get(entities, metrics.argmax(lls)), of)


def distinct_golds(golds: Column) -> Column:
    """The golds without those that equal an earlier one but for case."""
    return text.let(golds, lambda gs: F.filter(gs, lambda g, i: ~F.exists(F.slice(gs, F.lit(1), i), lambda x: F.lower(x) == F.lower(g))))


def conversation_answer(prediction: Column, golds: Column) -> Column:
    """struct(em, f1) of the prediction's first line: each gold left out in turn, the best of the others, averaged."""
    line = F.substring_index(text.strip(prediction), "\n", 1)
    em = lambda p: lambda g: (text.answer_normal(g) == text.answer_normal(p)).cast("double")
    both = lambda p, gs: F.struct(text.leave_one_out_best(gs, em(p)).alias("em"), text.leave_one_out_best(gs, lambda g: _squad(p, g)).alias("f1"))
    return text.let(line, lambda p: text.let(distinct_golds(golds), lambda gs: both(p, gs)))


def completion_score(prediction: Column, accepted: Column) -> Column:
    """struct(em, f1): the best over accepted completions, without ASCII punctuation, case and outer blanks."""
    normal = lambda c: text.strip(F.lower(F.translate(c, text.PUNCTUATION, "")))
    of = lambda p, gs: F.struct(F.array_contains(gs, p).cast("double").alias("em"), text.best_of(gs, lambda g: scoring.f1_or_equal(text.words(p), text.words(g))).alias("f1"))
    return text.let(normal(prediction), lambda p: text.let(F.transform(accepted, normal), lambda gs: of(p, gs)))


def option_bias(df: DataFrame, keys: list[str], ambiguous: str = "ambiguous", kind: str = "kind", answer: str = "answer", correct: str = "correct") -> DataFrame:
    """(keys, bias_ambiguous, bias_clear). Ambiguous: wrong answers for the stereotype less those against it, over all such questions. Clear: accuracy on questions whose right answer is for it (kind "pro") less that on those against it ("anti"). Null without such questions."""
    amb, right = F.col(ambiguous), F.col(correct)
    wrong = lambda side: F.count_if(amb & ~right & (F.col(answer) == side))
    share = lambda side: F.avg(F.when(F.col(kind) == side, right.cast("int")))
    return df.groupBy(*keys).agg(F.try_divide(wrong("pro") - wrong("anti"), F.count_if(amb)).alias("bias_ambiguous"), (share("pro") - share("anti")).alias("bias_clear"))


def accuracy_where(correct: Column, chosen: Column) -> Column:
    """Accuracy of the chosen rows, such as those of one prompt or one forced option, to four places; null if there are none."""
    return F.round(F.avg(F.when(chosen, correct.cast("double"))), 4)


def smoothed_bleu(prediction: Column, reference: Column) -> Column:
    """BLEU of one pair in 0 to 100: four orders, one added above and below from the second on, brevity by lengths plus one. Tokens: runs of letters and digits, and any other character alone."""
    tiny = sys.float_info.min
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1))

    def of(c):
        at = lambda n, i: F.get(c, F.lit(3 * (n - 1) + i))
        part = lambda n: F.log(at(n, 0) + int(n > 1) + F.lit(tiny)) - F.log(at(n, 1) + int(n > 1) + F.lit(tiny))
        mean = reduce(lambda a, b: a + b, [part(n) for n in range(1, 5)]) / 4
        return 100 * F.exp(mean + F.least(F.lit(0.0), 1 - (at(1, 2) + 1) / (at(1, 1) + 1)))

    return text.let(translation.gram_counts(tokens(prediction), tokens(reference), 4), of)


def first_positive(scores: Column) -> Column:
    """The first score over 0, else 0: what a document earns from several answers."""
    return F.coalesce(F.try_element_at(F.filter(scores, lambda x: x > 0), F.lit(1)), F.lit(0.0))


def flat_mean(scores: str) -> Column:
    """Mean over all elements of an array column's rows."""
    return F.try_divide(F.sum(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)), F.sum(F.size(scores)))


def option_named(response: Column, options: Column, *key) -> Column:
    """The letter of the option a response names: in brackets, else alone between blanks, else (over five words) by its content; the one named last. None named: one drawn by hash of the key, or null without a key."""
    trimmed = reduce(lambda c, ch: F.regexp_replace(c, f"\\A[{ch}]+|[{ch}]+\\z", ""), ",.!?;:'", response)
    letter = lambda i: F.char(F.lit(65) + i)

    def last(r, part):
        at = F.position(F.reverse(part), F.reverse(r))
        return F.when((at > 0) & (part != ""), F.length(r) - F.length(part) - (at - 1)).otherwise(F.lit(-1))

    def named(r, part):
        found = F.filter(F.transform(options, lambda o, i: F.struct(last(r, part(o, i)).alias("at"), (-i).alias("first"), letter(i).alias("letter"))), lambda x: x["at"] >= 0)
        return F.array_max(found)["letter"]

    def of(r):
        content = F.when(F.size(text.words(r)) > 5, named(F.lower(r), lambda o, i: F.lower(o)))
        drawn = letter(F.pmod(F.xxhash64(*key), F.size(options)).cast("int")) if key else F.lit(None).cast("string")
        return F.coalesce(named(r, lambda o, i: F.concat(F.lit("("), letter(i), F.lit(")"))), named(r, lambda o, i: F.concat(F.lit(" "), letter(i), F.lit(" "))), content, drawn)

    return text.let(F.concat(F.lit(" "), trimmed, F.lit(" ")), of)


def text_contrast(df: DataFrame, key: str, prediction: str, right: str, wrong: str) -> DataFrame:
    """(key, bleu, rouge1, rouge2, rougeLsum), each a contrast() of the prediction's scores against the right and the wrong references (arrays of texts; null ones don't count).

    Every pair of texts is a row, scored by itself, so a question of many references is no heavy row. BLEU is that of one sentence, ROUGE counts runs of ASCII letters and digits
    in lower case; both in 0 to 100. A key without a right or a wrong reference has null contrasts.
    """
    pairs = df.select(key, F.col(prediction).alias("pred"), F.inline(F.concat(_marked(right, True), _marked(wrong, False))))
    pairs = pairs.where("ref IS NOT NULL")
    lowered = lambda c: F.lower(F.translate(c, "\u0130", "i"))  # noqa: E731  each letter by itself: lower() alone makes two characters of it
    words = lambda c: text.words(F.regexp_replace(lowered(c), "[^a-z0-9]+", " "))
    rouge = [(100 * translation.rouge_n(words("pred"), words("ref"), n)).alias(f"rouge{n}") for n in (1, 2)]
    scored = pairs.select(key, "right", "pred", "ref", *rouge, (100 * text.rouge_lsum(lowered("pred"), lowered("ref"))).alias("rougeLsum"))
    counted = translation.bleu_counts(scored, [key, "right", "rouge1", "rouge2", "rougeLsum"]).withColumn("bleu", translation.sentence_bleu())
    names = ("bleu", "rouge1", "rouge2", "rougeLsum")
    lists = [F.collect_list(F.when(F.col("right") == r, F.col(n))).alias(f"{n}_{r}") for n in names for r in (True, False)]
    return counted.groupBy(key).agg(*lists).select(key, *[contrast(F.col(f"{n}_True"), F.col(f"{n}_False")).alias(n) for n in names])


def _marked(c: str, right: bool) -> Column:
    return F.transform(c, lambda x: F.struct(F.lit(right).alias("right"), x.alias("ref")))
