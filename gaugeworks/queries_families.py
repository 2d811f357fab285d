"""More queries of the engine: request shaping, filters and scores of single task families, results side by side; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import families, filters, metrics, text, translation
from .operators import requests as R
from .plans.evaluate import Metric, Task, evaluate, sample_metrics
from .queries import _PAIRS, _W, _label_samples, _pairs, _squad_sql, length_scorer, norm_sql, query, r6, tokens_sql

# ---- documents and requests
_NAMES = "CASE WHEN doc_id % 3 = 0 THEN 'needle ' || (1000000 + doc_id) || ' and ' || (2000000 + doc_id) WHEN doc_id % 3 = 1 THEN 'it is 1,' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ',777' ELSE 'none' END"


@query("SELECT doc_id FROM documents WHERE doc_id IN (3, 5, 8, 13, 100000000)")
def chosen_documents(t):
    return R.chosen(t("documents"), [3, 5, 8, 13, 100000000]).select("doc_id")


@query(f"SELECT doc_id, len({_W})::INT AS n FROM documents WHERE len({_W}) <= 60")
def documents_by_token_length(t):
    w = text.words(F.col("text"))
    return R.shorter_than(t("documents"), w, 60).select("doc_id", F.size(w).alias("n"))


@query(f"""SELECT doc_id, len({_W}) AS n, len(range(0, len({_W}), 64)) AS spans, CASE WHEN len({_W}) > 0 THEN len({_W}) - (len(range(0, len({_W}), 64)) - 1) * 64 ELSE 0 END AS last FROM documents""")
def fixed_token_spans(t):
    w = text.words(F.col("text"))
    d = t("documents").select("doc_id", F.size(w).cast("long").alias("n"), R.spans_of(w, 64).alias("s"))
    return d.select("doc_id", "n", F.size("s").cast("long").alias("spans"), F.coalesce(F.size(F.try_element_at("s", F.lit(-1))).cast("long"), F.lit(0)).alias("last"))


@query("SELECT conv_id, turn, rtrim(text || repeat(' ', turn::INT)) AS context, repeat(' ', length(text) - length(rtrim(text)) + turn::INT) || role AS continuation FROM conversations")
def pair_encoding(t):
    return t("conversations").select("conv_id", "turn", R.pair_encoded(F.concat("text", F.repeat(F.lit(" "), F.col("turn").cast("int"))), F.col("role")).alias("x")).select("conv_id", "turn", "x.*")


@query("SELECT conv_id, turn, [text, role, 'none'] AS before, turn % 3 AS gold FROM conversations".join(["WITH c AS (", """),
 x AS (SELECT conv_id, turn, before, gold, unnest(range(0, 3)) AS option FROM c)
 SELECT conv_id, turn, option::INT AS option, before[gold + 1] AS answer, CASE WHEN option = gold THEN before[1] ELSE CASE WHEN gold = 0 THEN before[option + 1] ELSE before[1] END END AS first FROM x WHERE option > 0"""]))
def expand_options(t):
    c = t("conversations").select("conv_id", "turn", F.array("text", "role", F.lit("none")).alias("choices"), (F.col("turn") % 3).cast("int").alias("gold"))
    x = R.expand_options(c).where("option > 0")
    return x.select("conv_id", "turn", "option", F.get("choices", F.col("gold")).alias("answer"), F.get("choices", 0).alias("first"))


@query(f"WITH a AS (SELECT conv_id, list_sort(list_distinct(flatten(list(list_transform({tokens_sql('text')}, lambda w: lower(w)))))) AS s FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_reduce(list_transform(s, lambda w: [w]), lambda a, w: CASE WHEN starts_with(w[1], a[-1]) THEN a ELSE list_concat(a, w) END), ' ') AS kept FROM a WHERE len(s) > 0")
def prefixed_aliases(t):
    a = t("conversations").groupBy("conv_id").agg(F.flatten(F.collect_list(F.transform(text.words(F.col("text")), F.lower))).alias("s")).where("size(s) > 0")
    return a.select("conv_id", F.array_join(R.without_prefixed(F.col("s")), " ").alias("kept"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort({_W}), ' ') AS sorted FROM conversations")
def shuffled_choices(t):
    s = R.shuffled(text.words(F.col("text")), F.col("conv_id"), F.col("turn"))
    return t("conversations").select("conv_id", "turn", F.array_join(F.array_sort(s), " ").alias("sorted"))


@query(f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(w) > 5 THEN w[-5:] ELSE w END, ' ') AS left_cut, array_to_string(w[1:5], ' ') AS right_cut,
 array_to_string(CASE WHEN len(w) <= 5 THEN w ELSE list_concat(w[1:2], w[-3:]) END, ' ') AS middle_cut FROM d""")
def token_truncation(t):
    d = t("documents").select("doc_id", text.words(F.col("text")).alias("w"))
    cut = lambda side: F.array_join(R.truncate(F.col("w"), 5, side), " ").alias(f"{side}_cut")
    return d.select("doc_id", cut("left"), cut("right"), cut("middle"))


@query("SELECT role AS context, count(*) AS asked, string_agg(text, '|' ORDER BY conv_id, turn) AS continuations FROM conversations GROUP BY role")
def requests_by_context(t):
    r = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("context"), F.col("text").alias("continuation"))
    return R.unique_contexts(r).select("context", F.size("asked").cast("long").alias("asked"), F.array_join(F.transform("asked", lambda x: x["continuation"]), "|").alias("continuations"))


# ---- detokenisers
_DIALOGUE = "text"
for _a, _b in families.DIALOGUE_STEPS:
    _DIALOGUE = f"replace({_DIALOGUE}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')".replace("\n", "' || chr(10) || '")
_GENERAL = "text"
for _a, _b in families.GENERAL_STEPS[:-1]:
    _GENERAL = f"replace({_GENERAL}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
_GENERAL = f"regexp_replace({_GENERAL}, ' ([''.,])', '\\1', 'g')"
_SPACED = "replace(replace(text, '.', ' .'), ',', ' ,')"


@query(f"WITH d AS (SELECT conv_id, turn, {_SPACED} AS text FROM conversations) SELECT conv_id, turn, {_DIALOGUE} AS dialogue, {_GENERAL} AS general FROM d")
def detokenised(t):
    spaced = F.replace(F.replace(F.col("text"), F.lit("."), F.lit(" .")), F.lit(","), F.lit(" ,"))
    return t("conversations").select("conv_id", "turn", families.rewritten(spaced, families.DIALOGUE_STEPS).alias("dialogue"), families.rewritten(spaced, families.GENERAL_STEPS).alias("general"))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_PAGE = "text"
for _a, _b in families.WIKI_STEPS:
    _PAGE = f"regexp_replace({_PAGE}, {_quoted(_a[3:])}, {_quoted(_b.replace('$1', chr(92) + '1'))}, 'g')" if _a.startswith("re:") else f"replace({_PAGE}, {_quoted(_a)}, {_quoted(_b)})"


@query(f"WITH b AS (SELECT item_id, {_SPACED} AS text FROM benchmark) SELECT item_id, {_PAGE} AS page FROM b")
def detokenised_pages(t):
    spaced = F.replace(F.replace(F.col("text"), F.lit("."), F.lit(" .")), F.lit(","), F.lit(" ,"))
    return t("benchmark").select("item_id", families.rewritten(spaced, families.WIKI_STEPS).alias("page"))


# ---- filters
@query("SELECT conv_id, turn, coalesce(CASE WHEN contains(m, 'th') THEN 'dental' WHEN contains(m, 'ch') THEN 'palatal' END, 'neither') AS kind FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?:th|ch)')[1] AS m FROM conversations)")
def filter_map_regex(t):
    f = families.map_regex({"th": "dental", "ch": "palatal"}, fallback="neither")
    return t("conversations").select("conv_id", "turn", f(F.array("text"))[0].alias("kind"))


@query("""WITH d AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: w IN ('the', 'and', 'of', 'de', 'la', 'der')) AS s FROM conversations)
 SELECT conv_id, turn, array_to_string(list_filter(s, lambda w, i: NOT list_contains(s[i + 1:], w)), ' ') AS words FROM d""")
def filter_word_sort(t):
    listed = F.array(*map(F.lit, ["the", "and", "of", "de", "la", "der"]))
    return t("conversations").select("conv_id", "turn", families.word_sort(listed)(F.array("text"))[0].alias("words"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'X Y' ELSE '[invalid]' END AS tags, 'last ' || item_id AS answer FROM benchmark")
def filter_tags_and_thinking(t):
    said = F.when(F.col("item_id") % 2 == 0, F.lit("[('a', 'X'), ('b', 'Y')]")).otherwise("nothing")
    thought = F.concat(F.lit("so </t> hm </t>\n  last "), F.col("item_id").cast("string"))
    return t("benchmark").select("item_id", filters.regex_pos()(F.array(said))[0].alias("tags"), text.after_thinking(thought, "</t>").alias("answer"))


@query("SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '(B)' WHEN 1 THEN '(A)' WHEN 2 THEN '(C)' ELSE '[invalid]' END AS choice FROM conversations")
def filter_multi_choice(t):
    k = F.col("conv_id") % 4
    said = F.when(k == 0, "it is (B)").when(k == 1, "answer: red, car!").when(k == 2, "my pick: C").otherwise("who knows")
    options = F.array(F.lit("Red car"), F.lit("Blue bus"), F.lit("Green van"))
    f = filters.multi_choice_regex(options, r"(\([A-Z]\))|answer", ignore_case=True, ignore_punctuation=True)
    return t("conversations").select("conv_id", "turn", f(F.array(said))[0].alias("choice"))


# ---- scores
@query(f"""WITH d AS (SELECT doc_id, {_NAMES} AS r FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (1000000 + doc_id) || ' ' || (2000000 + doc_id) WHEN doc_id % 3 = 1 THEN '1' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '777' ELSE 'none' END AS found,
 CASE WHEN doc_id % 3 = 0 THEN 0.5 WHEN doc_id % 3 = 1 AND doc_id % 1000 = 1 THEN 0.5 ELSE 0.0 END AS share FROM d""")
def needle_scores(t):
    own = F.concat(F.lit("1"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("777"))
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit("needle "), (F.col("doc_id") + 1000000).cast("string"), F.lit(" and "), (F.col("doc_id") + 2000000).cast("string"))).when(k == 1, F.concat(F.lit("it is 1,"), F.substring(own, 2, 3), F.lit(",777"))).otherwise("none")
    outputs = F.array(F.when(k == 0, (F.col("doc_id") + 1000000).cast("string")).otherwise("1001777"), F.lit("9999999"))
    d = t("documents").select("doc_id", said.alias("r"), outputs.alias("o"))
    return d.select("doc_id", families.needles(F.col("r"), F.col("o")).alias("found"), families.needle_share(F.col("r"), F.col("o")).alias("share"))


@query("SELECT event_type, round(coalesce(avg(v) FILTER (v <> -1), -1), 6) AS mean FROM (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE -1 END::DOUBLE AS v FROM events WHERE event_type <> 'view' OR event_id % 3 <> 0) GROUP BY event_type")
def mean_of_one_length(t):
    e = t("events").where("event_type <> 'view' OR event_id % 3 <> 0").select("event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).otherwise(-1).cast("double").alias("v"))
    return e.groupBy("event_type").agg(r6(families.mean_but()).alias("mean"))


@query("SELECT doc_id, (doc_id % 7 IN (n_chars % 7, 3) OR doc_id % 5 = n_chars % 7)::INT::DOUBLE AS acc FROM documents")
def paragraph_retrieval(t):
    said = F.concat(F.lit("See Paragraph "), (F.col("doc_id") % 7).cast("string"), F.lit(" or paragraph"), (F.col("doc_id") % 5).cast("string"), F.lit(", not 3"))
    gold = F.array(F.concat(F.lit("Paragraph "), (F.col("n_chars") % 7).cast("string")), F.lit("3"))
    acc = F.greatest(families.same_paragraph(said, F.slice(gold, 1, 1)), families.same_paragraph(F.concat(F.lit("paragraph "), (F.col("doc_id") % 7).cast("string")), gold))
    return t("documents").select("doc_id", acc.alias("acc"))


@query("""SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN p_size % 4 = 1 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN p_size = 2 ELSE p_size % 2 = 0 END)::INT::DOUBLE AS same FROM part""")
def latex_answers(t):
    s = F.col("p_size").cast("string")
    one = lambda m: (F.col("p_size") % m).cast("string")
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, F.concat(F.lit("x = \\dfrac"), one(4), F.lit("9"))).when(k == 1, F.concat(F.lit("\\sqrt"), one(7), F.lit(" \\text{ cm}"))).when(k == 2, F.concat(s, F.lit("/7"))).when(k == 3, F.concat(F.lit("\\left("), s, F.lit("\\right)\\%"))).otherwise(F.concat(F.lit("."), F.when(F.col("p_size") % 2 == 0, "5").otherwise("7")))
    gold = F.when(k == 0, F.lit("\\frac{1}{9}")).when(k == 1, F.concat(F.lit("\\sqrt{"), one(7), F.lit("}"))).when(k == 2, F.concat(F.lit("\\frac{"), s, F.lit("}{7}"))).when(k == 3, F.lit("(2)")).otherwise("1/2")
    return t("part").select("p_partkey", families.same_latex(said, gold).alias("same"))


@query(f"""WITH w AS (SELECT conv_id, turn, {_squad_sql(tokens_sql('text') + '[1]')} AS a, {_squad_sql(tokens_sql('text') + '[-1]')} AS p FROM conversations),
 g AS (SELECT conv_id, list(a) AS golds, list(p ORDER BY turn) AS ps FROM w GROUP BY conv_id)
 SELECT conv_id, round(len(list_filter(ps, lambda p: list_contains(golds, p))) / len(ps), 6) AS exact, (ps[1] <> '' AND list_contains(golds, ps[1]))::INT::DOUBLE AS f1, len(ps) AS n FROM g""")
def grouped_reading(t):
    w = text.words(F.col("text"))
    rows = t("conversations").select("conv_id", "turn", F.try_element_at(w, F.lit(-1)).alias("p"), F.try_element_at(w, F.lit(1)).alias("a"))
    return families.grouped_answers(rows, "conv_id", "turn", "p", "a").withColumn("exact", r6("exact"))


@query("""WITH x AS (SELECT event_type, (event_id % 97)::DOUBLE AS p, (event_id % 5) / 4.0 AS f1, (event_id % 5 = 4)::INT::DOUBLE AS exact, event_id % 3 > 0 AS has, event_id % 2 = 0 AS answered FROM events),
 s AS (SELECT *, CASE WHEN has THEN f1 ELSE (NOT answered)::INT END AS sf, CASE WHEN has THEN exact ELSE (NOT answered)::INT END AS se FROM x),
 b AS (SELECT event_type, p, sum(CASE WHEN has THEN f1 WHEN answered THEN -1 ELSE 0 END) AS gf, sum(CASE WHEN has THEN exact WHEN answered THEN -1 ELSE 0 END) AS ge, count(*) FILTER (NOT has) AS none, count(*) AS n FROM x GROUP BY ALL),
 r AS (SELECT *, sum(gf) OVER w AS uf, sum(ge) OVER w AS ue FROM b WINDOW w AS (PARTITION BY event_type ORDER BY p)),
 t AS (SELECT event_type, 100 * (sum(none) + greatest(max(uf), 0)) / sum(n) AS bf, 100 * (sum(none) + greatest(max(ue), 0)) / sum(n) AS be FROM r GROUP BY event_type)
 SELECT s.event_type, round(100 * avg(se), 5) AS exact, round(100 * avg(sf), 5) AS f1, round(100 * avg(se) FILTER (has), 5) AS has_exact, round(100 * avg(sf) FILTER (has), 5) AS has_f1,
 round(100 * avg(se) FILTER (NOT has), 5) AS no_exact, round(100 * avg(sf) FILTER (NOT has), 5) AS no_f1, round(any_value(be), 5) AS best_exact, round(any_value(bf), 5) AS best_f1 FROM s JOIN t USING (event_type) GROUP BY s.event_type""")
def squad_with_no_answers(t):
    e = t("events").select("event_type", (F.col("event_id") % 97).cast("double").alias("p"), ((F.col("event_id") % 5) / 4).alias("f1"), (F.col("event_id") % 5 == 4).cast("double").alias("exact"), (F.col("event_id") % 3 > 0).alias("has_answer"), (F.col("event_id") % 2 == 0).alias("answered"))
    r = families.with_no_answer(e, ["event_type"])
    return r.select("event_type", *[F.round(c, 5).alias(c) for c in r.columns if c != "event_type"])


@query("""WITH c AS (SELECT conv_id, turn, contains(text, 'the') AS a, contains(text, 'and') AS b, contains(text, 'on') AS c FROM conversations)
 SELECT conv_id, turn, round(CASE WHEN a THEN 1.0 / (a::INT + b::INT + c::INT) ELSE 0 END, 6) AS score FROM c""")
def classification_of_text(t):
    classes = F.array(F.lit("the"), F.lit("and"), F.lit("on"))
    return t("conversations").select("conv_id", "turn", r6(families.classification_score(F.col("text"), F.array(F.lit("the")), classes)).alias("score"))


@query("""WITH d AS (SELECT event_id, [abs(event_id % 10 - 5), abs(event_id % 7 - 2), abs(user_id % 10 - 9), abs(event_id % 3 - 1)]::DOUBLE[] AS d FROM events)
 SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE round(100 - 7.477 * list_sum(list_transform(d, lambda x: CASE WHEN x = 0 THEN 0 WHEN x <= 5 THEN 6.5 / (1 + exp(-1.2 * (x - 4))) ELSE x END)), 5) END AS score, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 100 END::DOUBLE AS parseable FROM d""")
def emotion_scores(t):
    part = lambda name, c, m: F.concat(F.lit(f"{name}: "), (F.col(c) % m).cast("string"), F.lit(" "))
    said = F.concat(part("Joy", "event_id", 10), part("Fear", "event_id", 7), part("Calm", "user_id", 10), F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(part("Awe", "event_id", 3)))
    names, scores = F.array(*map(F.lit, ["Joy", "Fear", "Calm", "Awe"])), F.array(*map(F.lit, [5.0, 2.0, 9.0, 1.0]))
    return t("events").select("event_id", families.emotion_score(said, names, scores).alias("x")).select("event_id", F.round("x.score", 5).alias("score"), "x.parseable")


@query("""WITH a AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS answer, count(*) AS n FROM events GROUP BY ALL)
 SELECT user_id, round(CASE WHEN sum(n) = 1 THEN 1 ELSE sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) END, 6) AS consistency FROM a GROUP BY user_id""")
def option_consistency(t):
    e = t("events").withColumns({"forced": F.lit("click"), "original": F.lit("view")})
    return families.option_consistency(e, ["user_id"], "event_type", "forced", "original").withColumn("consistency", r6("consistency"))


@query("""WITH s AS (SELECT event_type, sum((event_id % 4) / 4.0) AS s, greatest(sum((event_id % 4 > 0)::INT), 1) AS a, greatest(sum((event_id % 5 > 0)::INT), 1) AS t FROM events GROUP BY event_type)
 SELECT event_type, round(coalesce(2 * (s / a) * (s / t) / nullif(s / a + s / t, 0), 0), 6) AS f1 FROM s""")
def lexical_substitution(t):
    e = t("events").select("event_type", ((F.col("event_id") % 4) / 4).alias("precision"), (F.col("event_id") % 4 > 0).cast("int").alias("answered"), (F.col("event_id") % 5 > 0).cast("int").alias("annotated"))
    return e.groupBy("event_type").agg(r6(families.substitution_f1()).alias("f1"))


@query("""WITH x AS (SELECT event_type, event_id % 3 AS g, user_id % 3 AS p FROM events), n AS (SELECT event_type, l, count(*) FILTER (g = l AND p = l) AS tp, count(*) FILTER (g = l) + count(*) FILTER (p = l) AS s FROM x, (VALUES (0), (2)) AS y(l) GROUP BY ALL)
 SELECT event_type, round(sum(CASE WHEN s > 0 THEN 2.0 * tp / s ELSE 0 END) / 2, 6) AS f1 FROM n GROUP BY event_type""")
def f1_of_two_labels(t):
    e = t("events").select("event_type", (F.col("event_id") % 3).alias("gold"), (F.col("user_id") % 3).alias("pred"))
    return families.f1_of_labels(e, ["event_type"], [0, 2]).withColumn("f1", r6("f1"))


@query("SELECT p_partkey, (p_size = 5 OR p_partkey % 10 = 7 OR contains('size ' || p_size || ' key ' || (p_partkey % 10), 'key 1') OR p_partkey % 10 = 5 OR p_size = 7)::INT::DOUBLE AS exact_match FROM part")
def key_retrieval(t):
    said = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit("  key "), (F.col("p_partkey") % 10).cast("string"))
    return t("part").select("p_partkey", F.greatest(families.key_retrieval(said, F.array(F.lit("key 1"))), families.key_retrieval(F.concat(F.lit("<"), F.col("p_size").cast("string"), F.lit(">")), F.array(F.lit("zz"))), (F.arrays_overlap(F.array("p_size", (F.col("p_partkey") % 10).cast("int")), F.array(F.lit(5), F.lit(7)))).cast("double")).alias("exact_match"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l, 1 + label % 3 AS k FROM embeddings), e AS (SELECT vec_id, k, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM v)
 SELECT vec_id, round(list_sum(e[1:k]) / list_sum(e), 6) AS mc2 FROM e""")
def truthful_choices_split(t):
    k = 1 + F.col("label") % 3
    l = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", r6(families.mc2_split(l, F.transform(l, lambda x, i: (i < k).cast("int")))).alias("mc2"))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, CASE WHEN length(pred) >= 40 AND length(gold) >= 40 THEN 1.0 END AS scored, lower(array_to_string({tokens_sql("translate(pred, '" + text.PUNCTUATION.replace(chr(39), chr(39) * 2) + "', '')")}, ' ')) AS cleaned FROM p""")
def scored_unless_short(t):
    return _pairs(t).select("conv_id", "turn", families.unless_short(F.lit(1.0), F.col("pred"), F.col("gold"), 40).alias("scored"), families.cleaned(F.col("pred")).alias("cleaned"))


_F1 = "CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE 2.0 * list_sum(list_transform(list_concat(['']  , list_distinct({a})), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))) / (len({a}) + len({b})) END"


_OTHERS = "CASE WHEN len({0}) = 1 THEN {0}[1] ELSE list_sum(list_transform(range(1, len({0}) + 1), lambda i: list_max(list_filter({0}, lambda x, j: j <> i)))) / len({0}) END"


@query(f"""WITH c AS (SELECT conv_id, list({_W} ORDER BY turn) AS t FROM conversations GROUP BY conv_id HAVING count(*) > 2), x AS (SELECT conv_id, t[1] AS a, unnest(t[2:]) AS b, generate_subscripts(t[2:], 1) AS i FROM c),
 s AS (SELECT conv_id, list({_F1.format(a='a', b='b')} ORDER BY i) AS f FROM x GROUP BY conv_id)
 SELECT conv_id, round(list_max(f), 6) AS best, round(list_avg(f), 6) AS mean, round({_OTHERS.format('f')}, 6) AS left_out FROM s""")
def scores_over_references(t):
    c = t("conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w"))
    c = R.regroup(c, ["conv_id"], "w", ["turn"]).where("size(texts) > 2")
    refs, f1 = F.slice("texts", F.lit(2), F.size("texts") - 1), lambda g: text.token_f1(F.get("texts", 0), g)
    x = c.select("conv_id", families.over_references(refs, f1).alias("x"), text.best_of(refs, f1).alias("best"), text.leave_one_out_best(refs, f1).alias("o"))
    return x.select("conv_id", r6("best").alias("best"), r6("x.mean").alias("mean"), r6("o").alias("left_out"))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, list_distinct({tokens_sql(norm_sql('pred'))}) AS a, list_distinct({tokens_sql(norm_sql('gold'))}) AS b FROM p)
 SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS set_f1 FROM w""")
def set_scores(t):
    w = lambda c: text.words(families.cleaned(F.col(c)))
    return _pairs(t).select("conv_id", "turn", r6(text.set_f1(w("pred"), w("gold"))).alias("set_f1"))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, {tokens_sql('lower(pred)')} AS a, {tokens_sql('lower(gold)')} AS b FROM p),
 g AS (SELECT *, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS a2, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS b2 FROM w)
 SELECT conv_id, turn, round({_F1.format(a='a', b='b')}, 6) AS rouge1, round({_F1.format(a='a2', b='b2')}, 6) AS rouge2 FROM g""")
def rouge_n_scores(t):
    p = _pairs(t).withColumns({"a": text.words(F.lower("pred")), "b": text.words(F.lower("gold"))})
    return p.select("conv_id", "turn", *[r6(translation.rouge_n(F.col("a"), F.col("b"), n)).alias(f"rouge{n}") for n in (1, 2)])


# ---- tasks of every output type
_EVAL = f"d AS (SELECT item_id, text, {_W} AS w FROM benchmark)"


@query(f"""WITH {_EVAL}, l AS (SELECT item_id, w, text, -(len(regexp_extract_all(array_to_string(w, ' '), '[aeiou]')) + 0.01 * length(array_to_string(w, ' '))) AS one,
 list_sum(list_transform(list_concat([array_to_string(w[1:16], ' ')], list_transform(range(16, len(w), 16), lambda k: array_to_string(w[k + 1:k + 16], ' '))), lambda x: -(len(regexp_extract_all(x, '[aeiou]')) + 0.01 * length(x)))) AS ll FROM d)
 SELECT 'rolling' AS task, 'none' AS filter, m AS metric, round(CASE m WHEN 'word_perplexity' THEN exp(-sum(ll) / sum(len(w))) WHEN 'byte_perplexity' THEN exp(-sum(ll) / sum(strlen(text))) ELSE -sum(ll) / sum(strlen(text)) / ln(2) END, 5) AS value, count(*) AS n
 FROM l, (VALUES ('word_perplexity'), ('byte_perplexity'), ('bits_per_byte')) AS x(m) GROUP BY m""")
def evaluate_rolling(t):
    d = t("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    by = {"word_perplexity": ("words", "weighted_perplexity"), "byte_perplexity": ("bytes", "weighted_perplexity"), "bits_per_byte": ("bytes", "bits_per_byte")}
    task = Task("rolling", d, "loglikelihood_rolling", F.lit(""), F.col("text"), [Metric(m, lambda: F.col("ll"), how, weight=lambda w=w: F.col(w)) for m, (w, how) in by.items()], max_len=16)
    return evaluate(d.sparkSession, [task], length_scorer).select("task", "filter", "metric", F.round("value", 5).alias("value"), "n")


@query(f"""WITH {_EVAL}, x AS (SELECT lower(w[-1]) LIKE '%s.' AS p, length(text) % 2 = 0 AS g FROM d), n AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn, count(*) AS n FROM x)
 SELECT 'ends' AS task, m AS metric, round(CASE m WHEN 'f1' THEN coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) WHEN 'micro_f1' THEN (tp + tn) / n ELSE coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) END, 6) AS value, n FROM n, (VALUES ('f1'), ('micro_f1'), ('mcc')) AS y(m)""")
def evaluate_corpus_metrics(t):
    d = t("benchmark").select(F.col("item_id").alias("doc_id"), "text", (F.length("text") % 2 == 0).cast("int").alias("gold"))
    pred = lambda: F.endswith(F.lower("prediction"), F.lit("s.")).cast("int")
    task = Task("ends", d, "generate_until", F.col("text"), F.col("gold"), [Metric(m, lambda: F.lit(None), m, gold=lambda: F.col("target"), pred=pred) for m in ("f1", "micro_f1", "mcc")])
    return evaluate(d.sparkSession, [task], length_scorer).select("task", "metric", r6("value").alias("value"), "n")


@query("SELECT item_id AS doc_id, 1.0 AS v FROM benchmark")
def evaluate_unconditional(t):
    d = t("benchmark").select(F.col("item_id").alias("doc_id"), "text", F.array("text", F.lit("aaaa"), F.lit("eeee eeee")).alias("c"))

    def scorer(batches):
        for pdf in batches:
            long = pdf["continuation"].str.strip().str.len()
            pdf["ll"] = -1.0 * long + (pdf["context"] != "").astype(float) * long * (long != 4).astype(float) * (long != 9).astype(float)
            pdf["is_greedy"], pdf["text"] = False, ""
            yield pdf

    from .plans.evaluate import cached_or_scored, requests

    task = Task("items", d, "multiple_choice", F.col("text"), F.lit(0), [Metric("acc_mutual_info", lambda: metrics.acc_mutual_info(F.col("lls"), F.col("unconditional"), F.col("target")))], choices=F.col("c"), unconditional=True)
    return sample_metrics(task, cached_or_scored(requests(task), scorer)).select("doc_id", "v")


# ---- results
_RUNS = "r AS (SELECT source AS task, avg(quality) AS q, avg(toxic) AS x, stddev_samp(quality) / sqrt(count(*)) AS s FROM labels JOIN documents USING (doc_id) GROUP BY source)"


@query(f"WITH {_RUNS} SELECT task, 'acc,none' AS name, round(q, 6) AS value FROM r UNION ALL SELECT task, 'acc_stderr,none', round(s, 6) FROM r")
def consolidated_results(t):
    from .plans.evaluate import task_results

    return R.consolidated(task_results(_label_samples(t))).select("task", F.explode("results").alias("name", "value")).withColumn("value", r6("value"))


@query(f"WITH {_RUNS} SELECT task, round(q, 6) AS before, round(x, 6) AS after, round(x - q, 6) AS delta, CASE WHEN x > q THEN '+' WHEN x < q THEN '-' ELSE '=' END AS change FROM r")
def regression_between_runs(t):
    j = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    run = lambda c: j.groupBy(F.col("source").alias("task")).agg(F.avg(c).alias("value"))
    r = R.regression(run("quality"), run("toxic"), ["task"])
    return r.select("task", *[r6(c).alias(c) for c in ("before", "after", "delta")], "change")


@query("SELECT lang AS task, count(*) AS original, least(count(*), 150) AS effective FROM documents GROUP BY lang")
def sample_sizes(t):
    return R.sample_sizes(t("documents").withColumnRenamed("lang", "task"), "task", 150)


@query("""WITH r AS (SELECT user_id % 10 AS grp, event_type, event_id % 2 = 0 AS up FROM events) SELECT grp::VARCHAR AS "group", event_type AS metric, CASE WHEN min(up) <> max(up) THEN 'mixed' ELSE min(up)::VARCHAR END AS higher_is_better FROM r GROUP BY ALL""")
def merged_direction(t):
    e = t("events").select(F.col("event_id").cast("string").alias("task"), F.col("event_type").alias("metric"), (F.col("event_id") % 2 == 0).alias("higher_is_better"), (F.col("user_id") % 10).cast("string").alias("group"))
    return R.direction(e.drop("group"), e.select("group", "task")).withColumn("higher_is_better", F.coalesce(F.col("higher_is_better").cast("string"), F.lit("mixed")))
