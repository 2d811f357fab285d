"""More scores and filters of single task families: needles, paragraphs, detokenisers, LaTeX answers, grouped reading comprehension, answer maps."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, scoring, text

# What the needles of a haystack look like.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
NUMBER = r"\b\d{7}\b"
SEPARATED = r"\b\d[, _-]?\d{3}[, _-]?\d{3}\b"


def needles(response: Column, outputs: Column) -> Column:
    """The response reduced to the UUIDs or seven-digit numbers in it if the first output is one, joined by blanks; as it is if there are none.

    Numbers may have separators; failing that, all digits of the response may make one. Control characters count as line feeds.
    """
    find = lambda c, p: F.regexp_extract_all(c, F.lit(f"({p})"), F.lit(1))
    joined = lambda a, other: F.when(F.size(a) > 0, F.array_join(a, " ")).otherwise(other)
    sample = F.try_element_at(outputs, F.lit(1))

    def of(clean):
        digits = F.regexp_replace(clean, r"\D", "")
        bare = F.transform(find(clean, SEPARATED), lambda x: F.regexp_replace(x, r"\D", ""))
        numbers = joined(find(clean, NUMBER), joined(bare, joined(find(digits, NUMBER), clean)))
        return F.when(F.rlike(sample, F.lit(UUID)), joined(find(clean, UUID), clean)).when(F.rlike(sample, F.lit(NUMBER)), numbers).otherwise(clean)

    return text.let(text.strip(F.regexp_replace(text.strip(response), r"[\x00-\x1f]", "\n")), of)


def needle_share(response: Column, outputs: Column) -> Column:
    """Share of the outputs found among the response's needles."""
    return text.contains_all_share(needles(response, outputs), outputs)


def mean_but(v: str = "v", sentinel: float = -1.0) -> Column:
    """Mean of the values other than the sentinel; the sentinel if there are none."""
    return F.coalesce(F.avg(F.when(F.col(v) != sentinel, F.col(v))), F.lit(sentinel))


def paragraph_numbers(c: Column) -> Column:
    """Numbers of the paragraphs named; failing that, the first number."""
    low = F.lower(c)
    named = F.regexp_extract_all(low, F.lit(r"paragraph\s*(\d+)"), F.lit(1))
    return F.transform(F.when(F.size(named) > 0, named).otherwise(F.slice(F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1)), 1, 1)), lambda x: x.cast("long"))


def same_paragraph(response: Column, answers: Column) -> Column:
    """1 if the response names a paragraph that an answer names."""
    gold = F.flatten(F.transform(answers, paragraph_numbers))
    return F.coalesce(F.arrays_overlap(paragraph_numbers(response), gold), F.lit(False)).cast("double")


# Rewriting steps in order; a step that begins with "re:" is a pattern.
WIKI_STEPS = [("s '", "s'"), ("re:/' [0-9]/", "/'[0-9]/"), (" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", "."), (" : ", ": "), (" ; ", "; "), (" . ", ". "), (" ! ", "! "), (" ? ", "? "), (" , ", ", "), (r"re:\(\s*([^\)]*?)\s*\)", "($1)"), (r"re:\[\s*([^\]]*?)\s*\]", "[$1]"), (r"re:\{\s*([^}]*?)\s*\}", "{$1}"), (r're:"\s*([^"]*?)\s*"', '"$1"'), (r"re:'\s*([^']*?)\s*'", "'$1'"), ("= = = =", "===="), ("= = =", "==="), ("= =", "=="), (" \u00b0 ", "\u00b0"), (" \n", "\n"), ("\n ", "\n"), (" N ", " 1 "), (" 's", "'s")]
DIALOGUE_STEPS = [(" '", "'"), (" \n", "\n"), ("\n ", "\n"), (" n't", "n't"), ("`` ", '"'), ("''", '"'), (" :", ":"), (" ;", ";"), (" !", "!"), (" ?", "?"), (" ,", ","), (" .", ".")]
GENERAL_STEPS = [(" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"'), (r"re: (['.,])", "$1")]


def rewritten(c: Column, steps: list[tuple[str, str]]) -> Column:
    """A text after rewriting steps in turn, such as a detokeniser's."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0][3:], s[1]) if s[0].startswith("re:") else F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, c)


# LaTeX that does not change an answer, and what stands for it, in order.
LATEX_STEPS = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]


def latex_normal(t: str) -> str | None:
    """Normal form of a short LaTeX answer: units, degrees and blanks out, roots and fractions in braces, a/b and 0.5 as fractions. None if units stand twice."""
    for a, b in LATEX_STEPS:
        t = t.replace(a, b)
    t, *units = t.split("\\text{ ")
    if len(units) > 1:
        return None
    t = t.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    t = "0" + t if t.startswith(".") else t
    name, sign, value = t.partition("=")
    if sign and "=" not in value and len(name) <= 2:
        t = value
    t = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", t).replace(" ", "")
    if not re.search(r"\\frac[^{]?\Z", t):
        t = re.sub(r"\\frac([^{])(?:([^{])|(?=\{))", lambda m: f"\\frac{{{m[1]}}}" + (f"{{{m[2]}}}" if m[2] else ""), t)
    if t == "0.5":
        return "\\frac{1}{2}"
    if (m := re.fullmatch(r"(-?\d+)/(-?\d+)", t)) and all(str(int(x)) == x for x in m.groups()):
        return f"\\frac{{{m[1]}}}{{{m[2]}}}"
    return t


def same_latex(a: Column, b: Column) -> Column:
    """1 if both answers have one normal form, or are the same text where one has none."""

    @F.pandas_udf("double")
    def run(xs, ys):
        import pandas as pd

        def same(x, y):
            if x is None or y is None:
                return float(x is y)
            p, q = latex_normal(x), latex_normal(y)
            return float(p == q) if p is not None and q is not None else float(x == y)

        return pd.Series([same(x, y) for x, y in zip(xs, ys)])

    return run(a, b)


def grouped_answers(df: DataFrame, group: str, order: str, prediction: str, answer: str) -> DataFrame:
    """(group, exact, f1, n) of a reading-comprehension group: the share of its predictions that equal one of its answers, and the best token F1 of its first prediction; all in QA normal form."""
    rows = df.select(group, F.struct(order, text.answer_normal(F.col(prediction)).alias("p"), text.answer_normal(F.col(answer)).alias("a")).alias("x"))
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("x"))
    golds = F.transform("x", lambda x: x["a"])
    hits = F.size(F.filter("x", lambda x: F.array_contains(golds, x["p"])))
    parts = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    first = parts(F.get("x", 0)["p"])
    best = F.array_max(F.transform(golds, lambda a: text.token_f1(first, parts(a))))
    return g.select(group, (hits / F.size("x")).alias("exact"), best.cast("double").alias("f1"), F.size("x").cast("long").alias("n"))


def with_no_answer(df: DataFrame, keys: list[str], exact: str = "exact", f1: str = "f1", no_answer: str = "p", has_answer: str = "has_answer", answered: str = "answered") -> DataFrame:
    """(keys, exact, f1, has_exact, has_f1, no_exact, no_f1, best_exact, best_f1), in hundreds: overall, over questions with and without an answer, and at the best threshold. A question without an answer scores 1 if none was given."""
    score = lambda c: F.when(F.col(has_answer), F.col(c)).otherwise((~F.col(answered)).cast("double"))
    mean = lambda c, on: F.avg(F.when(on, score(c))) * 100
    every, has = F.lit(True), F.col(has_answer)
    out = df.groupBy(*keys).agg(*[mean(c, on).alias(name + kind) for name, on in (("", every), ("has_", has), ("no_", ~has)) for c, kind in ((exact, "exact"), (f1, "f1"))])
    for c, kind in ((exact, "exact"), (f1, "f1")):
        best = scoring.best_threshold(df, keys, c, no_answer, has_answer, answered)
        out = out.join(best.select(*keys, (F.col("best") * 100).alias(f"best_{kind}")), keys)
    return out


# --- response filters
def cleared(ignore_case: bool = False, ignore_punctuation: bool = False, regexes_to_ignore=()):
    """Each response without what the patterns find, then in lower case, then without punctuation of any script, as far as asked."""

    def one(t: Column) -> Column:
        for p in regexes_to_ignore or ():
            t = F.regexp_replace(t, F.lit(p), F.lit(""))
        t = F.lower(t) if ignore_case else t
        return F.regexp_replace(t, r"\p{P}", "") if ignore_punctuation else t

    return lambda texts: F.transform(texts, one)


def word_sort(listed: Column, **ignore):
    """The listed words in each response, in the order of their last occurrence, joined by blanks. ignore: what cleared() takes out of the responses before."""

    def one(t: Column) -> Column:
        seen = F.filter(F.regexp_extract_all(t, F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: F.array_contains(listed, w))
        last = lambda s: F.array_join(F.filter(s, lambda w, i: ~F.array_contains(F.slice(s, i + 2, F.greatest(F.size(s) - i - 1, F.lit(0))), w)), " ")
        return text.let(seen, last)

    return lambda texts: F.transform(cleared(**ignore)(texts), one)


def map_regex(values: dict[str, str], group_select: int = 0, fallback: str = "[invalid]", **ignore):
    """The group_select-th match of any of the patterns in each response, replaced by the value of the first pattern found in it. ignore: what cleared() takes out of the responses before."""
    union = "|".join(f"(?:{p})" for p in values)
    at = group_select + 1 if group_select >= 0 else group_select

    def one(t: Column) -> Column:
        found = text.strip(F.try_element_at(F.regexp_extract_all(t, F.lit(f"({union})"), F.lit(1)), F.lit(at)))
        return F.coalesce(*[F.when((found != "") & F.rlike(found, F.lit(p)), F.lit(v)) for p, v in values.items()], F.lit(fallback))

    return lambda texts: F.transform(cleared(**ignore)(texts), one)


# English number words.
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
_VALUES = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
_NUMBER_WORD = "|".join(sorted([*_VALUES, "hundred", *SCALES], key=len, reverse=True))
_NUMBER_RUN = re.compile(rf"(?:{_NUMBER_WORD})(?:(?:[^\S\r\n]|,|and|&)*(?:{_NUMBER_WORD}))*")


def number_of_words(run: str) -> int:
    """Value of number words, such as two hundred and five; a scale alone counts as one of it."""
    total = part = 0
    for w in re.findall(_NUMBER_WORD, run):
        if w in SCALES:
            total, part = total + (part or 1) * SCALES[w], 0
        elif w == "hundred":
            part = (part or 1) * 100
        else:
            part += _VALUES[w]
    return total + part


def number_parse(pattern: str, group_select: int = 0, fallback: str = "[invalid]", **ignore):
    """After cleared(**ignore), the group_select-th match of the pattern in each response, else the value of the group_select-th run of English number words, in digits. The longest word counts (sixteen, not six), also inside of others."""

    def one(t: str | None) -> str:
        found = re.findall(pattern, t or "")
        at = group_select if group_select >= 0 else len(found) + group_select
        if 0 <= at < len(found):
            m = found[at]
            m = next((x for x in m if x), "") if isinstance(m, tuple) else m
            if m.strip():
                return m.strip()
        runs = _NUMBER_RUN.findall((t or "").lower())
        at = group_select if group_select >= 0 else len(runs) + group_select
        return str(number_of_words(runs[at])) if 0 <= at < len(runs) else fallback

    @F.pandas_udf("array<string>")
    def run(texts):
        import pandas as pd

        return pd.Series([None if ts is None else [one(t) for t in ts] for ts in texts])

    return lambda texts: run(cleared(**ignore)(texts))


# --- scores
def classes_found(prediction: str, gold: str, classes: list[str]) -> float:
    """One over the number of classes found in the prediction if gold is among them. A found class that is part of gold goes, and the one after it is then passed over."""
    found, i = [c for c in classes if c in prediction], 0
    while i < len(found):
        if found[i] in gold and found[i] != gold:
            del found[i]
        i += 1
    return 1.0 / len(found) if gold in found else 0.0


def classification_score(prediction: Column, golds: Column, classes: Column) -> Column:
    @F.pandas_udf("double")
    def run(p, gs, cs):
        import pandas as pd

        return pd.Series([max([classes_found((t or "").strip(), g, list(c)) for g in gold], default=0.0) for t, gold, c in zip(p, gs, cs)])

    return run(prediction, golds, classes)


def emotion_score(response: Column, names: Column, scores: Column) -> Column:
    """struct(score, parseable): how near four named intensities come to the reference; 0 and not parseable unless exactly those four are named.

    Differences up to 5 weigh by a sigmoid, larger ones in full; the scale is such that random answers score 0.
    """

    @F.pandas_udf("struct<score:double,parseable:double>")
    def run(texts, names, scores):
        import pandas as pd

        rows = []
        for t, n, s in zip(texts, names, scores):
            want, got = dict(zip(n, s)), dict(re.findall(r"(\w+):\s+(\d+)", t or ""))
            if len(got) != 4 or set(got) != set(want):
                rows.append((0.0, 0.0))
                continue
            gaps = [abs(float(got[k]) - float(want[k])) for k in got]
            rows.append((100 - 7.477 * sum(0.0 if d == 0 else 6.5 / (1 + math.exp(-1.2 * (d - 4))) if d <= 5 else d for d in gaps), 100.0))
        return pd.DataFrame(rows, columns=["score", "parseable"])

    return run(response, names, scores)


def option_consistency(df: DataFrame, keys: list[str], final: str, forced: str, original: str) -> DataFrame:
    """Consistency of answers to one question with its right option moved about: the forced option counts as the original one."""
    return metrics.consistency(df.withColumn("__answer", F.when(F.col(final) == F.col(forced), F.col(original)).otherwise(F.col(final))), keys, "__answer")


def substitution_f1(precision: str = "precision", answered: str = "answered", annotated: str = "annotated") -> Column:
    """Aggregate F1 of lexical substitution: summed precisions over answered and over annotated items."""
    s = F.sum(precision)
    p, r = s / F.greatest(F.sum(answered), F.lit(1)), s / F.greatest(F.sum(annotated), F.lit(1))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def f1_of_labels(df: DataFrame, keys: list[str], labels: list, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(keys, f1): mean F1 of the listed labels only; a label never seen scores 0."""
    rows = metrics.per_class(df, keys, gold, pred)
    return rows.groupBy(*keys).agg((F.sum(F.when(F.col("label").isin(labels), F.col("f1")).otherwise(0.0)) / len(labels)).alias("f1"))


def key_retrieval(prediction: Column, golds: Column) -> Column:
    """1 if the response is a gold answer, holds a number that is one, or contains one."""
    flat = lambda c: F.array_join(text.words(c), " ")

    def of(p):
        g = F.filter(F.transform(golds, flat), lambda x: x != "")
        return (F.array_contains(F.transform(golds, flat), p) | F.arrays_overlap(F.regexp_extract_all(p, F.lit(r"(\d+)"), F.lit(1)), g) | F.exists(g, lambda x: F.contains(p, x))).cast("double")

    return text.let(flat(prediction), of)


def mc2_split(lls: Column, labels: Column) -> Column:
    """Normalised probability of the choices before the first that is labelled 0."""
    cut = F.array_position(labels, 0) - 1
    p = metrics.softmax(lls)
    return F.aggregate(F.filter(p, lambda _, i: i < cut), F.lit(0.0), lambda s, x: s + x)


def unless_short(score: Column, prediction: Column, reference: Column, least: int) -> Column:
    """The score, or null where either text is shorter than least characters."""
    return F.when((F.length(prediction) >= least) & (F.length(reference) >= least), score)


def cleaned(c: Column) -> Column:
    """No ASCII punctuation, single blanks, lower case."""
    return F.lower(F.array_join(text.words(F.translate(c, text.PUNCTUATION, "")), " "))


def over_references(references: Column, score) -> Column:
    """struct(best, mean) of a score over an array of references."""
    each = lambda s: F.struct(F.array_max(s).alias("best"), (F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)).alias("mean"))
    return text.let(F.transform(references, score), each)
