"""N-gram filters and stores, order statistics, bootstrap errors, templates, schemas, lines by byte ranges, packed contexts and code similarity against plain versions."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions import answers, bootstrap, common_runs, families, filters, metrics, ordering, scoring, similarity, text, translation
from gaugeworks.functions.json_schema import complies
from gaugeworks.functions.ordering import numbered
from gaugeworks.operators import corpus, long_context, sentences
from gaugeworks.operators import requests as R
from gaugeworks.operators.gram_store import GramStore
from gaugeworks.plans import catalog, templates
from gaugeworks.plans.evaluate import Metric, Task, evaluate, group_results, task_results
from gaugeworks.sources import offset_text, synthetic


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- n-gram filters
def test_filter_keeps_members_and_few_others(spark):
    seen = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    bits, blocks = corpus.gram_filter(seen.union(seen), 20_000)
    assert corpus.may_hold(seen, bits, blocks).count() == 20_000
    others = spark.range(1_000_000, 1_200_000).select(F.xxhash64("id").alias("h"))
    share = corpus.may_hold(others, bits, blocks).count() / 200_000
    assert share < 0.015  # measured false positives, 0.5 % by design
    assert corpus.may_hold(seen, *corpus.gram_filter(seen.limit(0), 0)).count() == 0


def test_shared_grams_by_filter_shuffle_only_survivors(spark, monkeypatch):
    r = random.Random(2)
    a = spark.createDataFrame([(i, " ".join(f"a{r.randrange(3000)}" for _ in range(60))) for i in range(300)] + [(300, "x y z common words here"), (301, None), (302, "")], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(f"b{r.randrange(3000)}" for _ in range(60))) for i in range(200)] + [(200, "some common words here too")], "item_id long, text string")
    left, right = corpus.shared_grams(a, b, 3, "doc_id", "item_id", broadcast_grams=100)
    assert left.join(right, "ngram").select("ngram", "doc_id", "item_id").collect() == [("common words here", 300, 200)]
    assert left.count() < 0.03 * 300 * 58 and right.count() < 0.03 * 200 * 58
    assert [x.doc_id for x in corpus.contaminated(a, b, 3, "doc_id", "item_id").collect()] == [300]
    stats = corpus.match_statistics(b, a, 3, "item_id", "doc_id").first()
    assert stats.matching == 1 and stats.unique == stats.matching + stats.non_matching and stats.total >= stats.unique
    none = corpus.match_statistics(b.limit(0), a, 3, "item_id", "doc_id").first()
    assert tuple(none) == (0, 0, 0, 0)


def test_larger_side_streams_by_unshuffled(spark):
    docs = spark.createDataFrame([(i, f"w{i} v{i} u{i} t{i}") for i in range(50)], "doc_id long, text string")
    bits, blocks = corpus.gram_filter(corpus._hashes(docs, 2), 200)
    plan = plan_of(corpus.may_hold(corpus._placed(docs, "doc_id", 2), bits, blocks))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


# ---- n-gram store
def test_store_joins_without_exchange_and_resumes(spark, tmp_path):
    d = spark.createDataFrame([(10, "a b c d"), (20, "b c d e"), (30, None), (40, "B, c! d")], "doc_id long, text string")
    placed = numbered(d, "doc_id")
    assert {r.doc_id: r.offset for r in placed.collect()} == {10: 0, 20: 1, 30: 2, 40: 3}
    store = GramStore(spark, "store_docs", 3, 4, f"file://{tmp_path}")
    items = GramStore(spark, "store_items", 3, 4, f"file://{tmp_path}")
    try:
        assert store.append(placed.where("offset < 2"), "first") and store.append(placed.where("offset >= 2"), "second")
        assert not store.append(placed, "first")
        # what an attempt without a marker left is not read
        placed.select("text", "offset", F.lit("third@" + "0" * 32).alias("part")).write.insertInto("store_docs")
        items.append(numbered(spark.createDataFrame([(1, "b c d")], "id long, text string"), "id"), "items")
        found = store.matches(items)
        assert sorted((r.ngram, r.offset, r.part, r.other_offset, r.other_part) for r in found.collect()) == [("b c d", 0, "first", 0, "items"), ("b c d", 1, "first", 0, "items"), ("b c d", 3, "second", 0, "items")]
        assert "Exchange" not in plan_of(found) and "SortMergeJoin" in plan_of(found)
        often = store.frequent(2)
        assert [tuple(r) for r in often.collect()] == [("b c d", 3)] and "Exchange" not in plan_of(often)
        spark.catalog.clearCache()
        spark.sql("DROP TABLE store_docs")
        again = GramStore(spark, "store_docs", 3, 4, f"file://{tmp_path}")
        assert again.frequent(2).count() == 1 and set(again.parts()) == {"first", "second"}
        with pytest.raises(ValueError, match="equal length"):
            again.matches(GramStore(spark, "store_docs", 2, 4, f"file://{tmp_path}"))
    finally:
        store.drop()
        items.drop()
    assert not os.path.exists(f"{tmp_path}/store_docs")


# ---- order statistics
@pytest.mark.parametrize("sorted_rows, ranges", [(50_000, 4096), (3, 4), (1, 2)])
def test_kth_by_ranges(spark, monkeypatch, sorted_rows, ranges):
    monkeypatch.setattr(ordering, "SORTED", sorted_rows)
    monkeypatch.setattr(ordering, "RANGES", ranges)
    r = random.Random(4)
    rows = [(f"g{r.randrange(3)}", r.choice([r.randrange(50), r.randrange(10**15), -r.randrange(10**6)]), r.random()) for _ in range(200)] + [("one", 5, 0.5), ("ties", 7, 0.1), ("ties", 7, 0.2), ("ties", 7, 0.3), ("g0", None, 9.0)]
    df = spark.createDataFrame(rows, "g string, x long, v double").repartition(3)
    for place in (lambda n: n // 2, lambda n: 0, lambda n: n - 1):
        expr = {0: F.expr("n div 2"), 1: F.lit(0), 2: F.col("n") - 1}[[place(7), place(8)] == [0, 0] and 1 or (2 if place(7) == 6 else 0)]
        got = {r.g: (r.x, r.v, r.n) for r in ordering.kth(df, ["g"], "x", expr, ["x", "v"]).collect()}
        for g in {r[0] for r in rows}:
            own = sorted((x, v) for k, x, v in rows if k == g and x is not None)
            assert got[g] == (*own[place(len(own))], len(own))
    every = sorted((x, v) for _, x, v in rows if x is not None)
    assert [tuple(r) for r in ordering.kth(df, [], "x", F.lit(100), ["v"]).collect()] == [(every[100][1], len(every))]
    assert ordering.kth(df, [], "x", F.lit(10_000), ["v"]).count() == 0 and ordering.kth(df.limit(0), ["g"], "x", F.lit(0), ["v"]).count() == 0


def test_limited_is_no_sort(spark):
    d = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert R.limited(d, 0.0501).count() == 51 and R.limited(d, 7).agg(F.max("doc_id")).first()[0] == 6
    assert R.limited(d, 5000).count() == 1000 and R.limited(d, 0).count() == 0 and R.limited(d.limit(0), 0.5).count() == 0
    assert "TakeOrdered" not in plan_of(R.limited(d, 0.5))


# ---- bootstrap
def test_weights_are_poisson_and_independent_of_layout(spark):
    w = bootstrap.weights(np.arange(4000), 500, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.06
    df = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("doc_id"), (F.col("id") * 0.5).alias("v"))
    sums = [sorted(map(tuple, bootstrap.replicate_sums(df.repartition(p), ["k"], ["v"], 20).collect())) for p in (1, 5)]
    assert sums[0] == sums[1] and len(sums[0]) == 40


def test_replicates_are_not_exploded(spark):
    df = spark.range(10).select(F.lit("a").alias("k"), F.col("id").alias("doc_id"), F.col("id").alias("v"))
    plan = plan_of(bootstrap.bootstrap_stderr(df, ["k"], 50))
    assert plan.index("Generate") < plan.index("MapInArrow") and plan.count("Generate") == 1  # arrays of sums, not rows


def test_errors_near_closed_forms(spark):
    r = np.random.default_rng(3)
    v = r.random(1000)
    gold, pred = r.integers(0, 2, 600), r.integers(0, 2, 600)
    pred = np.where(r.random(600) < 0.7, gold, pred)
    mean = bootstrap.bootstrap_stderr(spark.createDataFrame([("t", i, float(x)) for i, x in enumerate(v)], "task string, doc_id long, v double"), ["task"], 2000).first().stderr
    assert abs(mean / (v.std(ddof=1) / 1000**0.5) - 1) < 0.06
    df = spark.createDataFrame([("t", i, str(g), str(p)) for i, (g, p) in enumerate(zip(gold, pred))], "task string, doc_id long, gold string, pred string")

    def resampled(f):
        return np.std([f(*(x[at] for x in (gold, pred))) for at in (r.integers(0, 600, 600) for _ in range(1500))], ddof=1)

    f1 = lambda g, p: 2 * (g & p).sum() / (2 * (g & p).sum() + (g != p).sum())
    mcc = lambda g, p: np.corrcoef(g, p)[0, 1]
    for kind, f in (("f1", f1), ("mcc", mcc), ("micro_f1", lambda g, p: (g == p).mean())):
        assert abs(bootstrap.bootstrap_pairs(df, ["task"], kind, 1500).first().stderr / resampled(f) - 1) < 0.12
    median = bootstrap.bootstrap_stderr(df.select("task", "doc_id", F.col("doc_id").cast("double").alias("v")), ["task"], 300, of="median").first().stderr
    assert abs(median / (0.5 * 600**0.5) - 1) < 0.2  # the positional median of places, whose spread is half the root of n


def test_text_metrics_repeat_a_hundred_times_at_most(spark, monkeypatch):
    rows = [("t", i, f"the cat sat on mat {i} and it was good", f"a cat sat on the mat {i % 7} and it was very good") for i in range(40)]
    df = spark.createDataFrame(rows, "task string, doc_id long, pred string, gold string")
    asked = []
    real = bootstrap.replicate_sums
    monkeypatch.setattr(bootstrap, "replicate_sums", lambda d, k, s, n, *a: asked.append(n) or real(d, k, s, n, *a))
    got = {k: bootstrap.bootstrap_pairs(df, ["task"], k, 5000).first().stderr for k in ("bleu", "chrf", "ter")}
    assert asked == [100] * 3 and all(0 < x < 20 for x in got.values())
    w = bootstrap.weights(np.arange(40), 100, 1234)
    e = [translation.ter_edits(p.split(), g.split()) for _, _, p, g in rows]
    want = np.std([100 * (w[:, b] @ e) / (w[:, b] @ [len(g.split()) for *_, g in rows]) for b in range(100)], ddof=1)
    assert abs(got["ter"] - want) < 1e-9


def test_task_results_have_errors_of_pairs(spark):
    rows = [("t", "none", "m", i, None, None, str(i % 2), str((i // 3) % 2)) for i in range(60)] + [("t", "none", "med", i, float(i), None, None, None) for i in range(21)]
    df = spark.createDataFrame(rows, "task string, filter string, metric string, doc_id long, v double, w double, gold string, pred string")
    got = {r.metric: r for r in task_results(df, {"m": "mcc", "med": "median"}, 50).collect()}
    assert got["m"].stderr > 0 and got["med"].value == 10.0 and got["med"].stderr > 0 and got["med"].n == 21
    assert all(r.stderr is None for r in task_results(df, {"m": "mcc", "med": "median"}).collect())


def test_counts_of_grams_in_texts_and_words(spark):
    df = spark.createDataFrame([("a b a b c", "a b c a"), ("", "x"), (None, None)], "p string, r string")
    got = [r.c for r in df.select(translation.gram_counts(F.split("p", " "), F.split("r", " "), 2).alias("c")).collect()]
    assert got[0] == [4, 5, 4, 2, 4, 3] and got[2] == [0] * 6
    assert df.select(translation.gram_counts(F.col("p"), F.col("r"), 1).alias("c")).first().c == [7, 9, 7]
    assert df.select(F.round(translation.rouge_n(F.split("p", " "), F.split("r", " "), 2), 6).alias("x")).first().x == round(4 / 7, 6)


# ---- templates
SCHEMA = T.StructType([T.StructField("q", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("xs", T.ArrayType(T.StringType())), T.StructField("s", T.StructType([T.StructField("a", T.StringType()), T.StructField("ys", T.ArrayType(T.LongType()))])), T.StructField("none", T.StringType())])
ROW = (" Hi There ", 7, True, ["b", "a", "b"], ("x'y", [3, 1]), None)


@pytest.mark.parametrize(
    "template, want",
    [
        ("{{ q.strip() }}!", "Hi There!"),
        ("{{q|trim|lower}} {{ n + 1 }} {{ n // 2 }} {{ -n }} {{ n % 4 }} {{ n / 2 }}", "hi there 8 3 -7 3 3.5"),
        ("{{ ok }} {{ not ok }} {{ none }} {{ none is none }} {{ none is not none }}", "True False None True False"),
        ("{% if n > 5 and ok %}big{% elif n == 5 %}five{% else %}small{% endif %}", "big"),
        ("{% if not xs %}empty{% else %}{{ xs | length }}{% endif %}", "3"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}.", "1b, 2a, 3b."),
        ("{% for x in xs %}{% for y in s.ys %}{{ x ~ y }} {% endfor %}{% endfor %}", "b3 b1 a3 a1 b3 b1 "),
        ("{% for x in ['p', 'q'] %}{{ loop.index0 }}{{ x }}{% endfor %}{% for i in range(2) %}{{ i }}{% endfor %}", "0p1q01"),
        ("{% set t = q.strip().split(' ') %}{{ t[-1] }} {{ t | first }} {{ t | join('+') }} {{ ', '.join(xs) }}", "There Hi Hi+There b, a, b"),
        ("{{ xs[1:] | join('') }} {{ q[1:3] }} {{ q[-3:] | trim }} {{ xs[0] }} {{ 'abc'[1] }}", "ab Hi re b b"),
        ("{{ 'a' in xs }} {{ 'z' not in xs }} {{ 'Hi' in q }} {{ xs.index('a') }} {{ xs | sort | unique | join }}", "True True True 1 ab"),
        ("{{ s.a }} {{ s['a'] }} {{ s.ys | sort }} {{ xs }}", "x'y x'y [1, 3] ['b', 'a', 'b']"),
        ("{{ 'yes' if ok else 'no' }} {{ none | default('-') }} {{ 'n: ' ~ n }} {{ '3' | int + 1 }} {{ 'x' | int }}", "yes - n: 7 4 0"),
        ("{# a note #}{{ 'a|b' | replace('|', '~') }} {{- ' c' }}", "a~b c"),
        ("a  {%- if ok -%}  b  {%- endif -%}  c", "abc"),
        ("{{ q | regex_replace('[aeiou]', '_') | upper | trim }} {{ q.strip().capitalize() }}", "H_ TH_R_ Hi there"),
        ("no slots", "no slots"),
        ("", ""),
    ],
)
def test_templates(spark, template, want):
    assert spark.createDataFrame([ROW], SCHEMA).select(templates.compiled(template, SCHEMA).alias("t")).first().t == want


@pytest.mark.parametrize("bad", ["{{ nope }}", "{{ s.nope }}", "{{ q.nope() }}", "{{ q | nope }}", "{% if ok %}", "{% include 'x' %}", "{{ q q }}", "{{ __import__('os') }}", "{{ [x for x in xs] }}", "{{ q is nope }}"])
def test_templates_are_strict(bad):
    with pytest.raises(templates.TemplateError):
        templates.compiled(bad, SCHEMA)


def test_prompt_library(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("nli:\n  short: {prompt: '{{ q | trim }}?', target: n, choices: ['yes', 'no', '{{ xs[0] }}'], label: 1}\n  long: {prompt: 'Is {{ q | trim }}?', target: '{{ n }}', choices: ['y', 'n', 'm'], label: 2}\n")
    lib = templates.PromptLibrary.load(str(tmp_path / "p.yaml"))
    df = spark.createDataFrame([ROW], SCHEMA)
    assert lib.names("nli:*") == ["nli:long", "nli:short"]
    r = lib.apply(df, "nli:short").first()
    assert (r.prompt, r.target, r.choices, r.label, r.n) == ("Hi There?", 7, ["yes", "no", "b"], 1, 7)
    both = lib.apply_all(df, "nli:*").select("prompt_name", "prompt", "target", "label").collect()
    assert [tuple(x) for x in both] == [("nli:long", "Is Hi There?", 7, 2), ("nli:short", "Hi There?", 7, 1)]
    with pytest.raises(templates.TemplateError, match="no prompt"):
        lib.apply(df, "nli:none")


# ---- JSON schemas
@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": "integer"}, ["1", "1.0", "-3"], ["1.5", '"1"', "true", "null", "{", None, ""]),
        ({"type": ["string", "null"]}, ['"x"', "null"], ["0", "[]"]),
        ({"enum": [1, "a", None, [1, {"k": 2}]]}, ["1", "1.0", '"a"', "null", '[1,{"k":2}]'], ["2", '"b"', "[1]", '[1,{"k":3}]']),
        ({"const": {"a": [True]}}, ['{"a":[true]}'], ['{"a":[false]}', '{"a":[true],"b":1}', "[]"]),
        ({"minimum": 2, "exclusiveMaximum": 5, "multipleOf": 0.5}, ["2", "4.5", '"no number"'], ["1.5", "5", "2.3"]),
        ({"minLength": 2, "maxLength": 3, "pattern": "^é"}, ['"éa"', '"éab"', "7"], ['"é"', '"éabc"', '"ab"']),
        ({"type": "array", "items": {"type": "number"}, "minItems": 1, "maxItems": 3, "uniqueItems": True}, ["[1]", "[1,2,3.5]"], ["[]", "[1,1]", "[1,2,3,4]", '["a"]']),
        ({"prefixItems": [{"type": "string"}], "items": False, "contains": {"const": "x"}}, ['["x"]'], ['["x",1]', "[1]", '["y"]', "[]"]),
        ({"required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"items": {"minimum": 0}}}}}, "additionalProperties": {"type": "boolean"}}, ['{"a":{}}', '{"a":{"b":[1,"s"]},"c":true}', "[]"], ['{"a":{"b":[-1]}}', '{"c":true}', '{"a":{},"c":1}']),
        ({"patternProperties": {"^n": {"type": "number"}}, "additionalProperties": False, "minProperties": 1, "propertyNames": {"maxLength": 2}}, ['{"n1":1}'], ['{"n1":"x"}', '{"m":1}', "{}", '{"n11":1}']),
        ({"anyOf": [{"minimum": 10}, {"maximum": 1}], "not": {"const": 0}}, ["10", "1"], ["5", "0"]),
        ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, ["2", "3"], ["6", "5"]),
        ({"if": {"type": "string"}, "then": {"minLength": 1}, "else": {"type": "null"}}, ['"a"', "null"], ['""', "1"]),
        (True, ["1"], ["{"]),
        (False, [], ["1"]),
    ],
)
def test_json_schema(spark, schema, good, bad):
    df = spark.createDataFrame([(x,) for x in good + bad], "t string").coalesce(1)
    assert [r.ok for r in df.select(complies(F.col("t"), schema).alias("ok")).collect()] == [True] * len(good) + [False] * len(bad)


def test_json_schema_refuses_what_it_does_not_know():
    with pytest.raises(ValueError, match="unsupported"):
        complies(F.col("t"), {"$ref": "#/x"})


# ---- lines by byte ranges
@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_line_offsets_whatever_the_ranges(spark, tmp_path, size):
    data = "first\n\nzwei é漢\r\n\n" + "x" * 50 + "\nlast without an end"
    (tmp_path / "a.txt").write_bytes(data.encode())
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"\n")
    got = sorted((r.place, r.offset, r.line) for r in offset_text.read_lines(spark, str(tmp_path), size).collect())
    want, at = [], 0
    for line in data.split("\n"):
        want.append((at, at, line))
        at += len(line.encode()) + 1
    assert got == [*want, (at - 1, 0, "")]


def test_lines_are_appended_packed_and_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = spark.range(100).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("line")).coalesce(1)
    offset_text.append_lines(one, path)
    offset_text.append_lines(spark.createDataFrame([("é",), (None,)], "x string").coalesce(1), path)
    every = offset_text.read_lines(spark, path, 50)
    lines = [r.line for r in every.orderBy("place").collect()]
    assert lines == [f"line {i}" for i in range(100)] + ["é", ""]
    assert not os.path.exists(f"{tmp_path}/t/_temporary")
    reader = offset_text._Reader(path, 50)
    whole = len(reader.partitions())
    list(reader.pushFilters([offset_text.ds.GreaterThanOrEqual(("offset",), 700), offset_text.ds.LessThan(("offset",), 760)]))
    assert len(reader.partitions()) <= 3 < whole
    got = offset_text.read_lines(spark, path, 50).where("offset >= 700 AND offset < 760").collect()
    assert got and all(700 <= r.offset < 760 for r in got) and len(got) == sum(700 <= r.offset < 760 for r in every.collect())
    with pytest.raises(Exception, match="line feed"):
        offset_text.append_lines(spark.createDataFrame([("a\nb",)], "x string"), path)
    assert offset_text.read_lines(spark, path).count() == 102
    for kind in ("zstd", "gzip"):
        packed = f"{tmp_path}/{kind}"
        offset_text.append_lines(one, packed, kind)
        rows = offset_text.read_lines(spark, packed, 10).collect()
        assert sorted(r.line for r in rows) == sorted(lines[:100]) and {r.place for r in rows} == {None} or kind == "gzip" and len(rows) == 100
    offset_text.append_lines(one.limit(1), path, overwrite=True)
    assert [r.line for r in offset_text.read_lines(spark, path).collect()] == ["line 0"]


def test_long_lines_over_many_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(offset_text, "READ", 16)
    data = b"".join(bytes([97 + i % 26]) * n + b"\n" for i, n in enumerate([0, 100, 5, 0, 33, 15, 16, 17, 1]))
    import io

    for size in (5, 16, 40, 1000):
        got = []
        for a in range(0, len(data), size):
            stream = io.BytesIO(data)
            stream.seek(max(a - 1, 0))
            got += list(offset_text.lines_from(stream, a, min(a + size, len(data))))
        at, want = 0, []
        for line in data[:-1].split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        assert got == want


# ---- packed contexts
def test_packed_contexts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(1 + i % 9))) for i in range(80)] + [(99, None), (98, "  ")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the needle"), (2, "another one")], "item_id long, text string")
    for budget in (12, 60, 10_000):
        for r in long_context.packed(items, "item_id", "text", docs, "doc_id", [budget], [0, 30, 100]).collect():
            parts = r.input.split("\n\n")
            needle = {1: "the needle", 2: "another one"}[r.item_id]
            at = parts.index(needle)
            sizes = [len(p.split()) for p in parts]
            assert len(set(parts)) == len(parts) == r.n_docs + 1 and sum(sizes) - 2 == r.context_words <= budget
            assert r.before_words == sum(sizes[:at]) and r.before_words * 100 <= r.depth * r.context_words
            assert at == r.n_docs or (r.before_words + sizes[at + 1]) * 100 > r.depth * r.context_words
            assert r.context_words > budget - 18 or budget == 10_000 and r.n_docs == 80
    alone = long_context.packed(items, "item_id", "text", docs.limit(0), "doc_id", [5], [50]).collect()
    assert {r.input for r in alone} == {"the needle", "another one"}


def test_prompts_are_split_back(spark):
    df = spark.createDataFrame([("some\n\nQuestion: inner\ntext", "why?"), ("", "")], "c string, q string")
    p = long_context.prompt(F.col("c"), F.col("q"), "Read.", "Answer:")
    rows = df.select("c", "q", long_context.split_prompt(p, "Read.", "Answer:").alias("x"), long_context.split_prompt(F.col("c"), "Read.", "Answer:").alias("bare")).collect()
    assert all((r.x.context, r.x.question, r.x.prefix) == (r.c, r.q, "Answer:") for r in rows)
    assert rows[0].x.query == "Question: why?\nAnswer:" and rows[0].bare.question == "inner\ntext" and rows[1].bare == ("", "", "", "")
    keep = spark.createDataFrame([(0,), (10,), (60,), (95,)], "n int").select(long_context.keeps_raw(F.col("n"), F.lit(5), 10, 100, 200, 70).alias("k"))
    assert [r.k for r in keep.collect()] == [False, True, False, False]


# ---- code similarity
def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_length_equals_the_table():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("abé漢 ") for _ in range(r.randrange(0, 70))) for _ in range(2))
        assert text.common_length(a, b) == plain_common(a, b)


def test_code_similarity(spark):
    df = spark.createDataFrame([("\n# note\n// more\nx = 1\ny", ["x = 2", "zzz"]), ("`a`\n#", ["a"]), (None, ["a"]), ("a", None), ("same", ["same", None]), ("", [""])], "p string, g array<string>")
    got = [r.x for r in df.select(similarity.code_similarity(F.col("p"), F.col("g")).alias("x")).collect()]
    assert got == [0.8, 0.0, 0.0, 0.0, 1.0, 0.0]
    assert [r.x for r in df.select(similarity.indel_ratio(F.col("p"), F.lit("same")).alias("x")).collect()][4] == 1.0


# ---- common runs
def test_automaton_finds_the_longest_common_run(spark):
    r = random.Random(11)
    for _ in range(300):
        a, b = ([r.choice("abc漢") for _ in range(r.randrange(0, 60))] for _ in range(2))
        want = max((k for k in range(1, len(a) + 1) if {tuple(a[i : i + k]) for i in range(len(a) - k + 1)} & {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}), default=0)
        assert common_runs.Automaton(a).longest(b) == want
    long = [str(r.randrange(50)) for _ in range(20_000)]
    assert common_runs.Automaton(long).longest(["x", *long[5000:9000], "y", *long[:100]]) >= 4000
    df = spark.createDataFrame([("北京 is 大, ok", "is 大 , ok 北京"), ("", "a"), (None, "a"), ("a b", "c")], "p string, g string")
    p, g = (common_runs.mixed_tokens(F.col(c)) for c in "pg")
    got = df.select(p.alias("t"), common_runs.longest_common_run(p, g).alias("n"), common_runs.common_run_f1(p, g).alias("f")).collect()
    assert got[0].t == ["北", "京", "is", "大", ",", "ok"] and (got[0].n, round(got[0].f, 4)) == (4, 0.6667)
    assert [(x.n, x.f) for x in got[1:]] == [(0, 0.0)] * 3


# ---- sentences
def test_sentences_of_a_learnt_corpus(spark):
    r = random.Random(1)
    names = ["Meyer", "Adams", "Novak", "Silva"]
    texts = []
    for i in range(300):
        subject = r.choice(["the visitor", "a neighbour", "that doctor"])
        texts.append(f"We met Dr. {r.choice(names)} near the {r.choice(['river', 'house', 'market'])}. The {r.choice(['road', 'garden', 'shop'])} was quiet. The {r.choice(['old', 'new'])} door opened, and {subject} went inside. Quiet and inside the {r.choice(['river', 'house', 'market'])} nobody spoke, and it was quiet enough inside that river or house or market to sleep well.")
    model = sentences.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "dr" in {x.word for x in model.abbreviations.collect()} and not {"quiet", "inside", "river"} & {x.word for x in model.abbreviations.collect()}
    assert "the" in {x.word for x in model.starters.collect()}
    rows = [(1, "Dr. Meyer came. He left."), (2, "Is it? Yes! \"Good.\" Fine"), (3, "one"), (4, "  "), (5, None), (6, "We saw Dr. The end."), (7, "J. Adams paid 3. 4 came."), (8, "He met Dr. meyer today.")]
    got = {x.id: x.sentences for x in sentences.sentence_counts(spark.createDataFrame(rows, "id long, text string"), "id", model).collect()}
    assert got == {1: 2, 2: 4, 3: 1, 6: 2, 7: 1, 8: 1}
    asked = spark.createDataFrame([(1, "Title*\nOne. Two.\nbye", 3, "less than"), (2, "", 1, "at least"), (3, "Aa bb. Cc dd. Ee ff.", 3, "at least")], "id long, text string, n int, relation string")
    for loose, want in ((False, {1: False, 2: False, 3: True}), (True, {1: True, 2: False, 3: True})):
        assert {x.id: x.followed for x in sentences.enough_sentences(asked, "id", F.col("n"), F.col("relation"), model, loose).collect()} == want
    none = sentences.fit(spark.createDataFrame([], "doc_id long, text string"))
    assert sentences.sentence_counts(spark.createDataFrame(rows[:1], "id long, text string"), "id", none).first().sentences == 3


def test_capital_words():
    assert [scoring.follows(t, "change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}) for t in ("A BIG-ONE", "One TWO", "(NASA), \"UN\"!", "12 34")] == [True, False, True, False]


# ---- unigrams, groups, registries
def test_unigram_scores_with_and_without_a_head(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a a b c"), (2, "a b d e e f"), (3, ""), (4, None)], "doc_id long, text string")
    n, total = {"a": 3, "b": 2, "c": 1, "d": 1, "e": 2, "f": 1}, 10 + 6
    want = {1: sum(math.log((n[w] + 1) / total) for w in "aabc"), 2: sum(math.log((n[w] + 1) / total) for w in "abdeef")}
    for most in (100, 2):
        monkeypatch.setattr(corpus, "HEAD_WORDS", most)
        got = {r.doc_id: r.v for r in corpus.unigram_scores(docs, "doc_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert corpus.unigram_scores(docs.limit(0), "doc_id").count() == 0


def test_groups_of_several_metrics(spark):
    rows = [("a", "none", "acc", 0.5, 0.1, 10), ("b", "none", "acc", 1.0, None, 30), ("a", "none", "f1", 0.2, 0.1, 10), ("b", "strict", "f1", 0.6, 0.2, 30)]
    results = spark.createDataFrame(rows, "task string, filter string, metric string, value double, stderr double, n long")
    configs = {"g": {"group": "g", "task": ["a", {"task": "b", "repeats": 2}], "aggregate_metric_list": [{"metric": "acc"}, {"metric": "f1", "weight_by_size": False, "filter_list": ["none", "strict"]}]}, "top": {"group": "top", "task": ["g"], "aggregate_metric_list": {"metric": "acc", "weight_by_size": False}}, "plain": {"group": "plain", "task": ["c"]}}
    groups = catalog.groups(configs)
    assert [g.name for g in groups] == ["g", "top"]
    got = {(r.group, r.filter, r.metric): (round(r.value, 6), r.stderr is None, r.n) for r in group_results(results, groups).collect()}
    assert got == {("g", "none", "acc"): (0.875, True, 40), ("g", "none", "f1"): (0.2, False, 10), ("g", "strict", "f1"): (0.6, False, 30), ("top", "none", "acc"): (0.75, True, 40)}
    with pytest.raises(ValueError, match="only means"):
        catalog.groups({"g": {"group": "g", "task": ["a"], "aggregate_metric_list": [{"metric": "acc", "aggregation": "max"}]}})


def test_registries_take_new_names(spark, monkeypatch):
    monkeypatch.setattr(filters, "REGISTRY", dict(filters.REGISTRY))
    monkeypatch.setattr(metrics, "AGGREGATIONS", dict(metrics.AGGREGATIONS))
    monkeypatch.setattr(metrics, "LOWER_IS_BETTER", set(metrics.LOWER_IS_BETTER))

    @filters.register("twice")
    def twice(by=2):
        return lambda texts: F.transform(texts, lambda t: F.repeat(t, by))

    assert spark.range(1).select(filters.chain([("twice", {"by": 3}), ("take_first", {})])(F.array(F.lit("ab"))).alias("x")).first().x == ["ababab"]
    metrics.register("least", lambda: F.min("v"), higher_is_better=False)
    df = spark.createDataFrame([("t", "none", "least", i, float(i)) for i in (3, 1, 2)], "task string, filter string, metric string, doc_id long, v double")
    r = task_results(df, {"least": "least"}).first()
    assert (r.value, r.stderr, r.higher_is_better) == (1.0, None, False)
    for f in (lambda: filters.register("twice", twice), lambda: metrics.register("mean", lambda: F.avg("v"))):
        with pytest.raises(ValueError):
            f()


def test_too_few_examples_are_an_error(spark):
    d = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "doc_id long, text string, target string")
    with pytest.raises(ValueError, match="asked"):
        R.few_shot(d, d, 3)


# ---- right and wrong texts
def test_text_contrast(spark):
    rows = [(1, "the cat sat on the mat today", ["the cat sat on the mat", None], ["a dog ran", "the cat sat"]), (2, "no match", ["xx yy zz ww"], ["no match"]), (3, "alone", [], ["alone"]), (4, None, ["a"], ["b"])]
    df = spark.createDataFrame(rows, "k int, p string, r array<string>, w array<string>")
    got = {x.k: x for x in answers.text_contrast(df, "k", "p", "r", "w").collect()}
    assert got[1].bleu.acc == 1.0 and got[1].rouge1.best == pytest.approx(200 * 6 / 13) and got[1].rougeLsum.difference == pytest.approx(200 * 6 / 13 - 200 * 3 / 10)
    m, t = (6, 5, 4, 3), (7, 6, 5, 4)
    assert got[1].bleu.best == pytest.approx(100 * math.exp(sum(math.log(a / b) for a, b in zip(m, t)) / 4))
    assert got[2].bleu.best == 0 and got[2].rouge1.difference == -100.0 and got[2].rouge1.acc == 0.0
    assert got[3].bleu.best is None and got[3].bleu.difference is None and got[4].rouge1.best == 0.0
    smooth = spark.createDataFrame([("a b c d e", "a b x d y")], "pred string, ref string")
    assert translation.bleu_counts(smooth, []).select(translation.sentence_bleu().alias("b")).first().b == pytest.approx(100 * math.exp((math.log(3 / 5) + math.log(1 / 4) + math.log(1 / 2 / 3) + math.log(1 / 4 / 2)) / 4))


def test_filters_clear_responses_before(spark):
    texts = F.array(F.lit("The ANSWER is, B-2!"), F.lit("none"))
    f = lambda x: spark.range(1).select(x(texts).alias("x")).first().x
    assert f(families.map_regex({r"answer is b": "second"}, ignore_case=True, ignore_punctuation=True, regexes_to_ignore=["[0-9]"])) == ["second", "[invalid]"]
    assert f(families.map_regex({r"answer is b": "second"})) == ["[invalid]"] * 2
    assert f(families.number_parse(r"#(\d+)", ignore_punctuation=True)) == ["[invalid]", "1"]  # one in none
    assert f(families.word_sort(F.array(F.lit("b"), F.lit("the")), ignore_case=True)) == ["the b", ""]
    assert f(families.cleared(regexes_to_ignore=["[aeiou]"])) == ["Th ANSWER s, B-2!", "nn"]
    d = spark.createDataFrame([("a $x$ b $y$ c",), ("one $ only",), ("$\n$",), (None,)], "t string").select(scoring.between_dollars(F.col("t")).alias("x"))
    assert [r.x for r in d.collect()] == ["x$ b $y", "one $ only", "\n", None]


def test_the_model_is_asked_once_whatever_is_made_of_its_answers(spark, tmp_path):
    """Several aggregations, pair metrics and bootstrap errors over one task must not score its requests again."""
    folder = str(tmp_path)

    def scorer(batches):
        import uuid

        for b in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(b)))
            b["ll"], b["is_greedy"], b["text"] = 0.0, True, b["context"].str[-1]
            yield b

    docs = spark.createDataFrame([(i, f"q{i % 10}", str(i % 3)) for i in range(50)], "doc_id long, text string, target string")
    exact = lambda: (F.col("prediction") == F.col("target")).cast("double")
    chosen = [Metric("acc", exact), Metric("median", exact, "median"), Metric("ppl", exact, "perplexity"), Metric("mcc", lambda: F.lit(None), "mcc", gold=lambda: F.col("target"), pred=lambda: F.col("prediction"))]
    results = evaluate(spark, [Task("t", docs, "generate_until", F.col("text"), F.col("target"), chosen)], scorer, bootstrap=20).collect()
    assert {r.metric for r in results} == {"acc", "median", "ppl", "mcc"} and all(r.stderr is not None for r in results)
    assert sum(int((tmp_path / n).read_text()) for n in os.listdir(folder)) == 50


# ---- synthetic tasks
def test_synthetic_tasks_keep_their_answers(spark):
    noise = ["The grass is green.", "The sky is blue.", "The sun is yellow."]
    rows = synthetic.haystack(spark, [10, 40], [0, 50, 100], 5, noise).collect()
    assert len(rows) == 30
    for r in rows:
        parts = re.findall(r"[^.]+\.", r.input)
        at = next(i for i, x in enumerate(parts) if "magic" in x)
        assert len(parts) == r.length + 1 and at == r.length * r.depth // 100 and r.query in parts[at] and r.outputs[0] in parts[at]
    for r in synthetic.variable_chains(spark, 10, 3, 4, "The grass is green.").collect():
        assert f"VAR {r.outputs[0]} = {r.query}" in r.input and all(f"VAR {b} = VAR {a}" in r.input for a, b in zip(r.outputs, r.outputs[1:]))
    for r in synthetic.common_words(spark, 10, 5, 10).collect():
        listed = re.findall(r"\d+\. (\S+)", r.input)
        assert len(listed) == 5 * 30 + 10 * 3 and all(listed.count(w) == 30 for w in r.outputs)
    with pytest.raises(ValueError):
        synthetic.variable_chains(spark, 1, 9, 4, "x")
