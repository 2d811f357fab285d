"""Sentence borders learnt from a corpus without labels: abbreviations and sentence starters by log-likelihood ratios of counts (Kiss and Strunk, 2006)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words
from ..sources.scratch import written

# The published thresholds, and the chance that an abbreviation has its period.
ABBREVIATION, STARTER, WITH_PERIOD = 0.3, 30.0, 0.99
#: Abbreviations, or starters, that may be broadcast.
BROADCAST_WORDS = 1_000_000
#: Quotes and brackets that may stand around a word.
AROUND = "\"'()[]{}«»“”„‘’‚"


@dataclass(frozen=True)
class Model:
    """Tables of words, lower-cased and without their period; either grows with the corpus' vocabulary, so they are joined."""

    abbreviations: DataFrame
    starters: DataFrame


def _bare(w: Column) -> Column:
    return F.btrim(w, F.lit(AROUND))


def _word() -> tuple[Column, Column]:
    """The word x in lower case without its period, and whether it has one."""
    period = F.endswith("x", F.lit("."))
    return F.lower(F.when(period, F.expr("substring(x, 1, length(x) - 1)")).otherwise(F.col("x"))).alias("word"), period.alias("period")


def _words(docs: DataFrame, text: str) -> DataFrame:
    """(word, period): each word."""
    return docs.select(F.explode(F.transform(words(F.col(text)), _bare)).alias("x")).select(*_word())


def _ends(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, period, mark, next, big) of the words that may end a sentence, and of each text's last word: the word in lower case without its period, whether it has one, whether it ends by ? or !, the word after it (bare and lower; null after the last), and whether that begins with a capital.

    The others are left out before they are rows of their own."""

    def pairs(w):
        each = F.transform(w, lambda x, i: F.struct(x.alias("x"), F.get(w, i + 1).alias("y")))
        return F.filter(each, lambda p: p["y"].isNull() | F.substring(p["x"], -1, 1).isin(".", "?", "!"))

    rows = docs.select(key, F.inline(let(F.transform(words(F.col(text)), _bare), pairs)))
    first = F.substring("y", 1, 1)
    return rows.select(key, *_word(), F.substring("x", -1, 1).isin("?", "!").alias("mark"), F.lower(F.regexp_replace("y", r"[.,;:?!]+\z", "")).alias("next"), F.coalesce(first != F.lower(first), F.lit(False)).alias("big"))


def _log(n: Column, p: Column) -> Column:
    """n times the log of p, 0 for no n."""
    return F.when(n == 0, 0.0).otherwise(n * F.log(p))


def _abbreviation_score(whole: Column, with_period: Column, periods: int, total: int, word: Column) -> Column:
    """How much likelier the word's periods are if it is an abbreviation than if periods fall by chance; short words with periods inside gain, and every sight without one costs."""
    p, bare = F.lit(periods / max(total, 1)), whole - with_period
    chance = _log(with_period, p) + _log(bare, 1 - p)
    own = _log(with_period, F.lit(WITH_PERIOD)) + _log(bare, F.lit(1 - WITH_PERIOD))
    letters = F.length(F.replace(word, F.lit("."), F.lit("")))
    inside = F.length(word) - letters + 1
    return -2 * (chance - own) * F.exp(-letters * 1.0) * inside * F.pow(letters * 1.0, -bare * 1.0)


def _starter_score(breaks: int, whole: Column, starts: Column, total: int) -> Column:
    """Log-likelihood ratio of a word and the place after a sentence break."""
    a, n = F.lit(float(breaks)), F.lit(float(total))
    p, p1, p2 = whole / n, starts / a, (whole - starts) / (n - a)
    rest = n - a - whole + starts
    chance = _log(starts, p) + _log(a - starts, 1 - p) + _log(whole - starts, p) + _log(rest, 1 - p)
    own = F.when(starts == a, 0.0).otherwise(_log(starts, p1) + _log(a - starts, 1 - p1)) + F.when(whole == starts, 0.0).otherwise(_log(whole - starts, p2) + _log(rest, 1 - p2))
    return -2 * (chance - own)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Abbreviations and starters of all words of docs. Words are counted within tasks first, so a row a word and task is shuffled; three sums come to the driver."""
    counts = _words(docs, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if("period").alias("p"))
    counts = written(counts, "sentence-words")
    total, periods = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0))).first()
    counts = counts.where(F.regexp_like("word", F.lit(r"\p{L}")))
    score = _abbreviation_score(F.col("n"), F.col("p"), periods, total, F.col("word"))
    short = written(counts.where((F.col("p") > 0) & (score >= ABBREVIATION)).select("word"), "sentence-abbreviations")
    ends = _ends(docs, key, text).where(F.col("mark") | F.col("period")).where("next <> ''")
    starts = ends.join(short, "word", "left_anti").groupBy("next").agg(F.count(F.lit(1)).alias("s"))
    starts = written(starts, "sentence-starts")
    breaks = starts.agg(F.sum("s")).first()[0] or 0
    both = counts.join(starts, counts["word"] == starts["next"]).select("word", "n", "s")
    often = F.lit(float(total)) / max(breaks, 1) > F.col("n") / F.col("s")
    kept = both.where(often & (F.col("n") >= F.col("s")) & (_starter_score(breaks, F.col("n").cast("double"), F.col("s").cast("double"), total) >= STARTER)) if breaks else both.limit(0)
    return Model(short, written(kept.select("word"), "sentence-starters"))


def sentence_counts(docs: DataFrame, key: str, model: Model, text: str = "text") -> DataFrame:
    """(key, sentences) for every row of docs with a word; key must be unique.

    A sentence ends after a word with ? or !, and after one with a period unless that is an abbreviation, a single letter or a number: then only if the next word is
    a starter with a capital. The last word ends one in any case. Only words with a mark or a period are joined to the model.
    """
    rows = _ends(docs, key, text)
    if _few(model.abbreviations) and _few(model.starters):  # both are broadcast: one pass, and only a row a key and task is shuffled
        short = F.broadcast(model.abbreviations.withColumn("short", F.lit(True)))
        starter = F.broadcast(model.starters.select(F.col("word").alias("next"), F.lit(True).alias("starter")))
        met = rows.join(short, "word", "left").join(starter, "next", "left")
        end = F.col("next").isNotNull() & (F.col("mark") | F.col("period"))
        return met.groupBy(key).agg((F.count_if(end & _border()) + 1).alias("sentences"))
    short = model.abbreviations.withColumn("short", F.lit(True))
    starter = model.starters.select(F.col("word").alias("next"), F.lit(True).alias("starter"))
    ends = rows.where(F.col("next").isNotNull() & (F.col("mark") | F.col("period")))
    ends = ends.join(short, "word", "left").join(starter, "next", "left")
    counted = ends.groupBy(key).agg(F.count_if(_border()).alias("borders"))
    return rows.select(key).distinct().join(counted, key, "left").select(key, (F.coalesce("borders", F.lit(0)) + 1).alias("sentences"))


def _few(words: DataFrame) -> bool:
    return words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS


def _border() -> Column:
    """Whether a sentence ends after a word with a mark or a period."""
    doubtful = F.coalesce("short", F.lit(False)) | F.regexp_like("word", F.lit(r"\A(\p{L}|\p{N}+)\z"))
    return F.col("mark") | ~doubtful | (F.col("big") & F.coalesce("starter", F.lit(False)))


def response_forms(text: Column, loose: bool) -> Column:
    """The texts that an instruction may be judged on: the response; loosely also without its first, last, or first and last line, and each without asterisks."""
    if not loose:
        return F.array(text)

    def of(lines):
        n = F.size(lines)
        cut = lambda a, z: F.array_join(F.slice(lines, a + 1, F.greatest(n - a - z, F.lit(0))), "\n")
        # str.strip() of all but the whole response
        whole = [text, *(F.regexp_replace(cut(a, z), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "") for a, z in ((1, 0), (0, 1), (1, 1)))]
        return F.array(*whole, *(F.replace(x, F.lit("*"), F.lit("")) for x in whole))

    return let(F.split(text, "\n", -1), of)


def enough_sentences(docs: DataFrame, key: str, wanted: Column, relation: Column, model: Model, loose: bool = False, text: str = "text") -> DataFrame:
    """(key, followed) for every row: whether the response has, by relation ("less than", else "at least"), as many sentences as wanted; a blank one never has."""
    judged = enough_sentences_both(docs, key, wanted, relation, model, text, loose)
    return judged.select(key, F.col("loose" if loose else "strict").alias("followed"))


def enough_sentences_both(docs: DataFrame, key: str, wanted: Column, relation: Column, model: Model, text: str = "text", loose: bool = True) -> DataFrame:
    """(key, strict, loose): enough_sentences() by the response itself, and by any of its forms; the former is the first of the latter, and equal forms are judged once.

    Without some of its lines a text has part of its words, in the same order, so never more sentences: for "at least" none of these forms decides, only the whole text with and without asterisks.
    """
    judged = F.array(F.col(text))
    if loose:
        judged = F.when(relation == "less than", response_forms(F.col(text), True)).otherwise(F.array(F.col(text), F.replace(F.col(text), F.lit("*"), F.lit(""))))
    forms = docs.select(F.col(key).alias("k"), wanted.alias("wanted"), relation.alias("relation"), F.posexplode(F.array_distinct(judged)).alias("i", "form"))
    forms = forms.select(F.struct("k", "i", "wanted", "relation").alias("id"), "form")
    n = sentence_counts(forms, "id", model, "form").select("id.*", "sentences")
    holds = F.when(F.col("relation") == "less than", F.col("sentences") < F.col("wanted")).otherwise(F.col("sentences") >= F.col("wanted"))
    holds = F.coalesce(holds, F.lit(False))
    found = n.groupBy("k").agg(F.bool_or(holds & (F.col("i") == 0)).alias("strict"), F.bool_or(holds).alias("loose"))
    every = docs.select(key).distinct()  # a blank text has no count
    return every.join(found, F.col(key).eqNullSafe(F.col("k")), "left").select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("strict", "loose")])
