"""Queries of answers in several languages, entities, options and code comments, and of results and logs in other shapes; registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import answers, families, scoring, text, translation
from .operators import requests as R
from .operators import results
from .plans.evaluate import task_results
from .queries import _PAIRS, _RES, GRAMS, PUNCT_SQL, _label_samples, _pairs, _squad_sql, query, r6, tokens_sql
from .queries_families import _F1, _OTHERS

# ---- answers
_ARTICLES = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in answers.ARTICLES.items()) + " ELSE ['']::VARCHAR[] END"
_BARE = r"regexp_replace(lower({0}), '[\p{{P}}$+<=>^`|~]', '', 'g')"


@query(f"SELECT doc_id, array_to_string(list_filter({tokens_sql(_BARE.format('text'))}, lambda w: NOT list_contains({_ARTICLES}, w)), ' ') AS normal FROM documents")
def language_normal_forms(t):
    by = {k: answers.language_normal(F.col("text"), k) for k in ("en", "es", "de")}
    normal = F.when(F.col("lang") == "en", by["en"]).when(F.col("lang") == "es", by["es"]).when(F.col("lang") == "de", by["de"]).otherwise(answers.language_normal(F.col("text"), "hi"))
    return t("documents").select("doc_id", normal.alias("normal"))


_EN = "list_filter(" + tokens_sql(_BARE) + ", lambda w: w NOT IN ('a', 'an', 'the'))"
_HALF = "left(pred, (length(pred) // 2)::INT)"


def _with_half(t):
    p = _pairs(t)
    return p.withColumn("golds", F.array("gold", F.expr("left(pred, length(pred) div 2)")))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, {_EN.format('pred')} AS a, {_EN.format('gold')} AS b, {_EN.format(_HALF)} AS c FROM p)
 SELECT conv_id, turn, (a = b OR a = c)::INT::DOUBLE AS exact, round(greatest({_F1.format(a='a', b='b')}, {_F1.format(a='a', b='c')}), 6) AS f1 FROM w""")
def language_answers(t):
    return _with_half(t).select("conv_id", "turn", answers.language_answer(F.col("pred"), F.col("golds"), "en").alias("x")).select("conv_id", "turn", "x.exact", r6("x.f1").alias("f1"))


_PLAIN = "lower(translate({0}, '" + PUNCT_SQL.replace("{", "{{").replace("}", "}}") + "', ''))"
_SAME = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN ({a} = {b})::INT ELSE " + _F1 + " END"


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, {tokens_sql(_PLAIN.format('pred'))} AS a, {tokens_sql(_PLAIN.format('gold'))} AS b, {tokens_sql(_PLAIN.format(_HALF))} AS c,
 trim({_PLAIN.format('pred')}) IN (trim({_PLAIN.format('gold')}), trim({_PLAIN.format(_HALF)})) AS e FROM p)
 SELECT conv_id, turn, e::INT::DOUBLE AS em, round(greatest({_SAME.format(a='a', b='b')}, {_SAME.format(a='a', b='c')}), 6) AS f1 FROM w""")
def completion_scores(t):
    return _with_half(t).select("conv_id", "turn", answers.completion_score(F.col("pred"), F.col("golds")).alias("x")).select("conv_id", "turn", "x.em", r6("x.f1").alias("f1"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, 1 + label % 8 AS k FROM embeddings), m AS (SELECT vec_id, list_max(e[1:k]) AS a, list_max(e[k + 1:]) AS b FROM e)
 SELECT vec_id, round(a, 6) AS best, round(a - b, 6) AS difference, (a > b)::INT::DOUBLE AS acc FROM m""")
def right_and_wrong_references(t):
    e, k = F.col("embedding").cast("array<double>"), 1 + F.col("label") % 8
    x = t("embeddings").select("vec_id", answers.contrast(F.filter(e, lambda _, i: i < k), F.filter(e, lambda _, i: i >= k)).alias("x"))
    return x.select("vec_id", r6("x.best").alias("best"), r6("x.difference").alias("difference"), "x.acc")


_Q = lambda e: f"string_split({_squad_sql(e)}, ' ')"


@query(f"""WITH l AS (SELECT p_partkey, [p_size % 3, p_partkey % 4, 1] AS l, [p_brand, p_type, p_name] AS e, p_name AS g, upper(p_type) || ' the' AS h FROM part), x AS (SELECT p_partkey, e[list_position(l, list_max(l))] AS p, g, h FROM l),
 w AS (SELECT p_partkey, {_Q('p')} AS a, {_Q('g')} AS b, {_Q('h')} AS c FROM x)
 SELECT p_partkey, (a = b OR a = c)::INT::DOUBLE AS em, round(greatest({_F1.format(a='a', b='b')}, {_F1.format(a='a', b='c')}), 6) AS f1 FROM w""")
def entity_answers(t):
    lls = F.array((F.col("p_size") % 3).cast("double"), (F.col("p_partkey") % 4).cast("double"), F.lit(1.0))
    x = answers.entity_answer(lls, F.array("p_brand", "p_type", "p_name"), F.array("p_name", F.concat(F.upper("p_type"), F.lit(" the"))))
    return t("part").select("p_partkey", x.alias("x")).select("p_partkey", "x.em", r6("x.f1").alias("f1"))


@query(f"""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id HAVING count(*) > 1),
 g AS (SELECT conv_id, split_part(trim(t[1], ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1) AS p, list_filter(t[2:], lambda x, i: NOT list_contains(list_transform(t[2:i], lambda y: lower(y)), lower(x))) AS g FROM c),
 x AS (SELECT conv_id, {_Q('p')} AS a, unnest(g) AS gold, generate_subscripts(g, 1) AS i FROM g), b AS (SELECT conv_id, a, {_Q('gold')} AS b, i FROM x),
 s AS (SELECT conv_id, list((a = b)::INT::DOUBLE ORDER BY i) AS e, list({_F1.format(a='a', b='b')} ORDER BY i) AS f FROM b GROUP BY conv_id)
 SELECT conv_id, round({_OTHERS.format('e')}, 6) AS em, round({_OTHERS.format('f')}, 6) AS f1 FROM s""")
def conversation_answers(t):
    c = R.regroup(t("conversations").select("conv_id", "turn", "text"), ["conv_id"], "text", ["turn"]).where("size(texts) > 1")
    x = c.select("conv_id", answers.conversation_answer(F.get("texts", 0), F.slice("texts", F.lit(2), F.size("texts") - 1)).alias("x"))
    return x.select("conv_id", r6("x.em").alias("em"), r6("x.f1").alias("f1"))


@query("""WITH x AS (SELECT lang, doc_id % 2 = 0 AS amb, ['pro', 'anti', 'none'][doc_id % 3 + 1] AS kind, CASE WHEN toxic = 1 THEN 'pro' ELSE 'anti' END AS a, quality = 1 AS ok FROM labels JOIN documents USING (doc_id))
 SELECT lang, round((count(*) FILTER (amb AND NOT ok AND a = 'pro') - count(*) FILTER (amb AND NOT ok AND a = 'anti')) / nullif(count(*) FILTER (amb), 0), 6) AS bias_ambiguous, round(avg(ok::INT) FILTER (kind = 'pro') - avg(ok::INT) FILTER (kind = 'anti'), 6) AS bias_clear FROM x GROUP BY lang""")
def option_bias(t):
    kind = F.element_at(F.array(F.lit("pro"), F.lit("anti"), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int"))
    x = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("doc_id") % 2 == 0).alias("ambiguous"), kind.alias("kind"), F.when(F.col("toxic") == 1, "pro").otherwise("anti").alias("answer"), (F.col("quality") == 1).alias("correct"))
    b = answers.option_bias(x, ["lang"])
    return b.select("lang", r6("bias_ambiguous").alias("bias_ambiguous"), r6("bias_clear").alias("bias_clear"))


@query("SELECT user_id, round(avg((event_type = 'click')::INT) FILTER (event_id % 3 = 0), 4) AS prompt_0, round(avg((event_type = 'click')::INT) FILTER (event_id % 3 = 1), 4) AS prompt_1 FROM events GROUP BY user_id")
def accuracy_by_prompt(t):
    at = lambda k: answers.accuracy_where(F.col("event_type") == "click", F.col("event_id") % 3 == k).alias(f"prompt_{k}")
    return t("events").groupBy("user_id").agg(at(0), at(1))


_CODE = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"
_CLIP = "coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda x: x = g))))), 0)"
_ORDERS = ", ".join(f"{GRAMS.format(t=c, n=n)} AS {c}{n}" for c in "pr" for n in range(1, 5))
_LOGS = " + ".join(f"ln({_CLIP.format(a=f'p{n}', b=f'r{n}')} + {int(n > 1)} + 2.2250738585072014e-308) - ln(greatest(len(p) - {n - 1}, 0) + {int(n > 1)} + 2.2250738585072014e-308)" for n in range(1, 5))


@query(f"WITH {_PAIRS}, w AS (SELECT conv_id, turn, {_CODE.format('pred')} AS p, {_CODE.format('gold')} AS r FROM p), g AS (SELECT conv_id, turn, p, r, {_ORDERS} FROM w) SELECT conv_id, turn, round(100 * exp(({_LOGS}) / 4 + least(0, 1 - (len(r) + 1) / (len(p) + 1))), 5) AS bleu FROM g")
def smoothed_bleu_pairs(t):
    return _pairs(t).select("conv_id", "turn", F.round(answers.smoothed_bleu(F.col("pred"), F.col("gold")), 5).alias("bleu"))


@query("SELECT lang, round(avg(CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 / 4.0 WHEN n_chars % 2 = 1 THEN 1 ELSE 0 END), 6) AS score FROM documents GROUP BY lang")
def first_positive_answers(t):
    s = F.array((F.col("doc_id") % 4 / 4).cast("double"), (F.col("n_chars") % 2).cast("double"))
    return t("documents").groupBy("lang").agg(r6(F.avg(answers.first_positive(s))).alias("score"))


@query("SELECT label, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) / sum(len(embedding)), 6) AS mean FROM embeddings GROUP BY label")
def mean_over_parts(t):
    return t("embeddings").withColumn("s", F.col("embedding").cast("array<double>")).groupBy("label").agg(r6(answers.flat_mean("s")).alias("mean"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'B' END AS option FROM events")
def options_named(t):
    k = F.col("event_id") % 5
    said = F.when(k == 0, "I say (B), no: (C).").when(k == 1, "'the answer is A'!").when(k == 2, "it must clearly be the blue bus here").when(k == 3, "both the red car and then the blue bus").otherwise("no idea")
    return t("events").select("event_id", answers.option_named(said, F.array(F.lit("Red car"), F.lit("Blue bus"), F.lit("Green van"))).alias("option"))


@query("SELECT p_partkey, p_name || '{' || p_size || '}' AS answer FROM part")
def boxed_answers(t):
    said = F.concat(F.lit("first \\boxed{1}, so \\boxed{"), "p_name", F.lit("{"), F.col("p_size").cast("string"), F.lit("}} holds"))
    return t("part").select("p_partkey", scoring.boxed(said).alias("answer"))


@query("SELECT p_partkey, (p_partkey % 2 = 0)::INT::DOUBLE AS exact, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS f1 FROM part")
def span_sets(t):
    gold = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", "p_brand")).otherwise(F.array("p_name"))
    return t("part").select("p_partkey", scoring.spans_exact_f1(F.array("p_brand", "p_name"), F.array(gold)).alias("x")).select("p_partkey", "x.*")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1,' || (event_id % 900 + 100) WHEN 1 THEN '205' WHEN 2 THEN '3021000' WHEN 3 THEN '16' ELSE '[invalid]' END AS number FROM events")
def filter_number_parse(t):
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.concat(F.lit("I count 1,"), (F.col("event_id") % 900 + 100).cast("string"), F.lit(" of two"))).when(k == 1, "Two hundred and five").when(k == 2, "it is three million, twenty one thousand").when(k == 3, "sixteen, then\nfour").otherwise("a few")
    return t("events").select("event_id", families.number_parse(r"(\d[\d,]*)")(F.array(said))[0].alias("number"))


_SAID = "CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN chr(34) || text || chr(34) WHEN 2 THEN '<<Title>>' || chr(10) || text || ' [name] *bold*' ELSE lower(text) || chr(10) || '- item' || chr(10) || '* item two' END"
_CHECKS = [
    ("keywords:existence", '{"keywords": ["th", "on"]}', "contains(l, 'th') AND contains(l, 'on')"),
    ("keywords:frequency", '{"keyword": "th", "frequency": 5, "relation": "at least"}', "len(regexp_extract_all(l, 'th')) >= 5"),
    ("keywords:forbidden_words", '{"forbidden_words": ["and", "la"]}', r"NOT regexp_matches(l, '(^|[^\p{L}\p{N}_])(and|la)($|[^\p{L}\p{N}_])')"),
    ("length_constraints:number_words", '{"num_words": 40, "relation": "less than"}', r"len(regexp_extract_all(s, '[\p{L}\p{N}_]+')) < 40"),
    ("detectable_content:number_placeholders", '{"num_placeholders": 1}', r"len(regexp_extract_all(s, '\[.*?\]')) >= 1"),
    ("detectable_format:number_bullet_lists", '{"num_bullets": 2}', r"len(list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '^\s*(\*[^*]|-)'))) = 2"),
    ("detectable_format:number_highlighted_sections", '{"num_highlights": 1}', "contains(s, '*bold*')"),
    ("detectable_format:title", "{}", "contains(s, '<<Title>>')"),
    ("startend:quotation", "{}", "length(f) > 1 AND starts_with(f, chr(34)) AND ends_with(f, chr(34))"),
    ("change_case:english_lowercase", "{}", "s = l AND s <> upper(s)"),
    ("combination:repeat_prompt", '{"prompt_to_repeat": "<<title>>"}', "starts_with(lower(f), '<<title>>')"),
]
_STATED = ", ".join(f"(f <> '' AND {c})::INT" for *_, c in _CHECKS)


@query(f"WITH d AS (SELECT conv_id, turn, {_SAID} AS s FROM conversations), x AS (SELECT *, lower(s) AS l, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS f FROM d) SELECT conv_id, turn, array_to_string([{_STATED}], '') AS followed FROM x")
def instruction_checks(t):
    k, s = F.col("conv_id") % 4, F.col("text")
    said = F.when(k == 0, s).when(k == 1, F.concat(F.lit('"'), s, F.lit('"'))).when(k == 2, F.concat(F.lit("<<Title>>\n"), s, F.lit(" [name] *bold*"))).otherwise(F.concat(F.lower(s), F.lit("\n- item\n* item two")))
    followed = scoring.instructions_followed(said, F.array(*[F.lit(n) for n, *_ in _CHECKS]), F.array(*[F.lit(a) for _, a, _ in _CHECKS]))
    return t("conversations").select("conv_id", "turn", F.array_join(F.transform(followed, lambda x: x.cast("int").cast("string")), "").alias("followed"))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id % 4 AS k, {tokens_sql('lower(pred)')} AS a, {tokens_sql('lower(gold)')} AS b FROM p), g AS (SELECT *, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS a2, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS b2 FROM w)
 SELECT k, round(avg({_F1.format(a='a', b='b')}), 6) AS rouge1, round(avg({_F1.format(a='a2', b='b2')}), 6) AS rouge2 FROM g GROUP BY k""")
def rouge_of_corpus(t):
    w = lambda c: text.words(F.lower(c))
    p = _pairs(t).select((F.col("conv_id") % 4).alias("k"), *[translation.rouge_n(w("pred"), w("gold"), n).alias(f"rouge{n}") for n in (1, 2)])
    return p.groupBy("k").agg(*[r6(F.avg(c)).alias(c) for c in ("rouge1", "rouge2")])


@query()
def rouge_lsum_scores(t):
    return _pairs(t).select("conv_id", "turn", r6(text.rouge_lsum(F.col("pred"), F.col("gold"))).alias("rougeLsum"))


@query(f"SELECT role, round(avg(len({tokens_sql(_PLAIN.format('text'))})), 6) AS words FROM conversations GROUP BY role")
def mean_cleaned_words(t):
    return t("conversations").groupBy("role").agg(r6(F.avg(F.size(text.words(families.cleaned(F.col("text")))))).alias("words"))


# ---- results and logs
@query(f"WITH {_RES} SELECT task, 'acc' AS metric, printf('%.2f', 100 * value) AS value, coalesce(printf('%.2f', 100 * stderr), '') AS stderr FROM r")
def percent_results(t):
    return results.percent_table(task_results(_label_samples(t)))


@query(f"WITH {_RES} SELECT task, 'acc' AS metric, round(value, 6) AS value FROM r UNION ALL SELECT DISTINCT lang, ' ', NULL FROM documents")
def groups_without_values(t):
    r = task_results(_label_samples(t)).select("task", "metric", r6("value").alias("value"))
    return results.with_bare_groups(r, t("documents").select(F.col("lang").alias("task")).unionByName(r.select("task")))


@query(f"WITH {_RES} SELECT 'acc' AS metric, round(max(value) FILTER (task = 'src0') - max(value) FILTER (task = 'src1'), 6) AS value FROM r WHERE task IN ('src0', 'src1')")
def difference_of_tasks(t):
    return results.group_difference(task_results(_label_samples(t)), "src0", "src1", ["metric"]).withColumn("value", r6("value"))


def _logged(t):
    d = t("benchmark").select(F.col("item_id").alias("doc_id"), "text", F.array(F.lit("yes"), F.lit("no"), F.length("text").cast("string")).alias("c"))
    logged = results.arguments(R.multiple_choice(d, F.col("text"), F.col("c")))
    return logged.join(d.select("doc_id", (F.col("doc_id") % 3).cast("string").alias("target"), (F.length("text") % 2 == 0).alias("is_greedy")), "doc_id").withColumn("filter", F.lit("none"))


@query("""WITH d AS (SELECT *, text || chr(10) || chr(10) || '-  yes' || chr(10) || '-  no' || chr(10) || '-  ' || length(text) AS data FROM benchmark)
 SELECT item_id || '.none' AS id, item_id AS doc_id, data, length(data) AS input_len, (item_id % 3)::VARCHAR AS labels, 'multiple_choice' AS output_type FROM d""")
def viewer_documents(t):
    return results.viewer_documents(_logged(t), "multiple_choice", filtered=True).withColumn("input_len", F.col("input_len").cast("long"))


@query("SELECT item_id::VARCHAR AS id, item_id AS doc_id, CASE WHEN length(text) % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS output, (item_id % 3)::VARCHAR AS target FROM benchmark")
def viewer_outputs(t):
    return results.viewer_outputs(_logged(t), "loglikelihood", ["target"])


@query("SELECT conv_id, text AS answers FROM conversations")
def rows_of_answers(t):
    return results.answer_rows(R.collect_by_key(t("conversations"), "conv_id", "text", "turn").withColumnRenamed("values", "answers"))


@query("""WITH r AS (SELECT a.item_id AS doc_id, b.text, row_number() OVER (PARTITION BY a.item_id ORDER BY b.item_id) AS rn, b.item_id AS pid FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id),
 s AS (SELECT doc_id, string_agg('user: ' || text || chr(10) || 'assistant: So yes' || chr(10), '' ORDER BY pid) AS shots FROM r WHERE rn <= 2 GROUP BY doc_id)
 SELECT doc_id, 'system: Answer.' || chr(10) || shots || 'user: ' || text AS rendered FROM s JOIN benchmark b ON b.item_id = s.doc_id""")
def few_shot_chat(t):
    b = t("benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("yes").alias("target"))
    m = R.few_shot_chat(b, b, 2, system="Answer.", prefix="So")
    return m.select("doc_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("rendered"))


@query("SELECT role, count(*) AS requests, true AS bounded, true AS longest_first FROM conversations GROUP BY role")
def batched_requests(t):
    c = t("conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.length("text").alias("n"))
    b = results.collated(c, ["role"], F.col("n"), 8, 3)
    one = b.groupBy("batch").agg(F.first("role").alias("role"), F.count(F.lit(1)).alias("k"), F.countDistinct("role").alias("roles"), F.max("n").alias("most"), F.min("n").alias("least"), F.first("batch.n").alias("at"), F.first("batch.__part").alias("part"))
    # within a range the batches' lengths must fall: summed gaps to the next batch are never negative
    from pyspark.sql import Window

    nxt = F.lead("most").over(Window.partitionBy("part", "role").orderBy("at"))
    return one.withColumn("falls", F.coalesce(F.col("least") >= nxt, F.lit(True))).groupBy("role").agg(F.sum("k").alias("requests"), F.bool_and((F.col("k") <= 8) & (F.col("roles") == 1)).alias("bounded"), F.bool_and("falls").alias("longest_first"))
