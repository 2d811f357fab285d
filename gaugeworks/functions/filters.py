"""Response filters: each maps a column of response arrays to one; chains are named and run side by side."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, strip

Filter = Callable[[Column], Column]


def regex(pattern: str, group_select: int = 0, fallback: str = "[invalid]") -> Filter:
    """The group_select-th match (negative from the end) in each response; of several groups the first that isn't empty. Fallback without a match."""
    groups = re.compile(pattern).groups
    at = group_select + 1 if group_select >= 0 else group_select

    def one(c: Column) -> Column:
        found = [F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(g)), F.lit(at)) for g in (range(1, groups + 1) if groups else (0,))]
        first = reduce(lambda a, b: F.coalesce(a, b), [F.when(x != "", x) for x in found])
        matched = found[0].isNotNull()
        return F.when(matched, strip(F.coalesce(first, F.lit("")))).otherwise(fallback)

    return lambda texts: F.transform(texts, lambda t: one(F.coalesce(t, F.lit(""))))


def regex_pos(fallback: str = "[invalid]") -> Filter:
    """Tags of ('token', 'TAG') pairs in each response, joined by blanks."""
    tags = lambda t: F.regexp_extract_all(t, F.lit(r"\('([^']*)', '([^']*)'\)"), F.lit(2))
    return lambda texts: F.transform(texts, lambda t: F.when(F.size(tags(t)) > 0, F.array_join(tags(t), " ")).otherwise(fallback))


def remove_whitespace() -> Filter:
    return lambda texts: F.transform(texts, strip)


def lowercase() -> Filter:
    return lambda texts: F.transform(texts, F.lower)


def uppercase() -> Filter:
    return lambda texts: F.transform(texts, F.upper)


def map_values(mapping: dict[str, str], default: str | None = None) -> Filter:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return lambda texts: F.transform(texts, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(default)))


def take_first() -> Filter:
    return lambda texts: F.slice(texts, 1, 1)


def take_first_k(k: int) -> Filter:
    return lambda texts: F.slice(texts, 1, k)


def majority_vote() -> Filter:
    """The most frequent response; of equally frequent ones the first seen."""

    def vote(texts: Column) -> Column:
        ranked = F.transform(texts, lambda t, i: F.struct(F.size(F.filter(texts, lambda x: x.eqNullSafe(t))).alias("n"), (-i).alias("early"), t.alias("text")))
        return F.when(F.size(texts) > 0, F.array(F.array_max(ranked)["text"])).otherwise(texts)

    return lambda texts: let(texts, vote)


# Entity words and their labels, replaced in this order, and the pattern of a labelled entity.
SPAN_LABELS = {"person": "PER", "location": "LOC", "organization": "ORG", "counties": "LOC", "places": "LOC", "people": "PER", "persons": "PER", "company": "ORG", "country": "LOC", "continent": "LOC", "time": "DATE", "date": "DATE", "per": "PER", "loc": "LOC", "org": "ORG"}


SPAN = r"(?U)\b(PER|LOC|ORG|DATE):\s*([^$]+)"


def format_span() -> Filter:
    """Named entities as 'label: value' joined by ' $ ', with 'none' left out."""
    def one(t: Column) -> Column:
        t = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), SPAN_LABELS.items(), F.lower(t))
        t = F.regexp_replace(F.replace(t, F.lit("$$"), F.lit("$")), r"\$+\z", "")
        t = strip(F.replace(t, F.lit("\n"), F.lit("$")))
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(SPAN), F.lit(1)).alias("l"), F.regexp_extract_all(t, F.lit(SPAN), F.lit(2)).alias("v"))
        named = F.flatten(F.transform(pairs, lambda p: F.transform(F.filter(F.transform(F.split(p["v"], ","), strip), lambda v: F.lower(v) != "none"), lambda v: F.concat(F.lower(p["l"]), F.lit(": "), v))))
        return F.array_join(named, " $ ")

    return lambda texts: F.transform(texts, one)


def custom(fn: Callable[[list[str]], list[str]]) -> Filter:
    """A Python function of one request's responses, run on Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else list(fn(list(t))) for t in texts])

    return run


def multi_choice_regex(choices: Column, pattern: str, group_select: int = 0, ignore_case: bool = False, ignore_punctuation: bool = False, fallback: str = "[invalid]", ignore: tuple[str, ...] = ()) -> Filter:
    """The option letter as '(A)': by the pattern, else by the option's own text (without case, punctuation and what patterns match, if so asked), else by a letter after a colon."""

    @F.pandas_udf("array<string>")
    def run(texts, options):
        import pandas as pd

        def form(s):
            s = s.lower() if ignore_case else s
            for p in ignore:
                s = re.sub(p, "", s)
            return "".join(c for c in s if not unicodedata.category(c).startswith("P")) if ignore_punctuation else s

        def pick(found):
            m = found[group_select]
            return next((x for x in m if x), "") if isinstance(m, tuple) else m

        def one(text, opts):
            letters = [chr(65 + i) for i in range(len(opts))]
            named = {form(o.strip()): f"({a})" for o, a in zip(opts, letters)}
            if (found := re.findall(pattern, text or "")) and (first := pick(found).strip()):
                return first
            if named and (found := re.findall("|".join(re.escape(k) for k in named), form(text or ""))):
                return named[found[group_select]]
            if letters and (found := re.findall(rf":[\s]*({'|'.join(letters)})", text or "")):
                return f"({found[group_select]})"
            return fallback

        return pd.Series([[one(t, list(o)) for t in ts] for ts, o in zip(texts, options)])

    return lambda texts: run(texts, choices)


REGISTRY: dict[str, Callable[..., Filter]] = {"regex": regex, "regex_pos": regex_pos, "remove_whitespace": remove_whitespace, "lowercase": lowercase, "uppercase": uppercase, "map": map_values, "take_first": take_first, "take_first_k": take_first_k, "majority_vote": majority_vote, "format_span": format_span, "custom": custom, "multi_choice_regex": multi_choice_regex}


def register(name: str, make: Callable[..., Filter] | None = None):
    """Add a filter under a name of its own, by a call or as a decorator; options of a chain's step go to make. A name that is taken is an error."""
    if make is None:
        return lambda f: register(name, f)
    if name in REGISTRY:
        raise ValueError(f"there is a filter {name!r}")
    REGISTRY[name] = make
    return make


def chain(steps: list[tuple[str, dict]]) -> Filter:
    built = [REGISTRY[name](**options) for name, options in steps]
    return lambda texts: reduce(lambda x, f: f(x), built, texts)


def apply_chains(responses: DataFrame, chains: dict[str, list[tuple[str, dict]]], column: str = "texts") -> DataFrame:
    """responses with a row for each chain: its name in filter, its result in filtered. One scan serves all chains."""
    results = F.array(*[F.struct(F.lit(n).alias("filter"), chain(s)(F.col(column)).alias("filtered")) for n, s in chains.items()])
    return responses.select(*responses.columns, F.inline(results))
