"""Queries of what must hold at any size: n-gram filters and stores, bootstrap errors over pairs, compiled prompts and schemas, lines by byte ranges, packed contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import answers, bootstrap, common_runs, families, scoring, similarity, text
from .functions.json_schema import complies
from .functions.ordering import numbered, numbered_rows
from .operators import corpus, long_context, sentences
from .operators import requests as R
from .operators.gram_store import GramStore
from .plans import catalog
from .plans.evaluate import group_results, task_results
from .plans.templates import PromptLibrary
from .queries import _LETTERS, _OF_LETTERS, _OF_TOKENS, _PAIRS, _TOKENS, GRAMS, PUNCT_SQL, _pairs, query, r6, tokens_sql, weights_sql
from .sources.offset_text import append_lines, read_lines
from .sources.scratch import removed, shared_folder, written

# the library lowers ASCII letters only
_T = tokens_sql(f"translate(text, '{text.UPPER}{PUNCT_SQL}', '{text.LOWER}')")


def _grams_sql(name: str, rows: str, columns: str, n: int) -> str:
    return f"{name} AS (SELECT DISTINCT {columns}, unnest({GRAMS.format(t='t', n=n)}) AS ngram FROM (SELECT {columns}, {_T} AS t FROM {rows}))"


# ---- n-grams
@query(f"WITH {_grams_sql('d', 'documents', 'doc_id', 3)}, {_grams_sql('c', 'conversations', 'conv_id', 3)} SELECT DISTINCT doc_id FROM d WHERE ngram IN (SELECT ngram FROM c)")
def conversation_overlap_3gram(t):
    """Documents that share three words with a conversation, by filters of bits: no more than a thousand hashes may be broadcast as they are."""
    own, other = corpus.shared_grams(t("documents"), t("conversations"), 3, "doc_id", "conv_id", broadcast_grams=1_000)
    return own.join(other.select("ngram").distinct(), "ngram", "left_semi").select("doc_id").distinct()


def _store(t, name: str, table, order: str, parts: dict, n: int, among) -> GramStore:
    """A new store of a table's n-grams among those that will be asked for, a part after the other."""
    placed = written(numbered(table, order), "store-rows")
    store = GramStore(placed.sparkSession, f"{name}_{uuid.uuid4().hex}", n, 16)
    for part, rows in parts.items():
        store.append(placed.where(rows), part, among=among)
    removed(placed, among[0])
    return store


def _documents_store(t, n: int, among) -> GramStore:
    known = ["de", "en", "es", "fr"]
    parts = {k: F.col("lang") == k for k in known} | {"other": ~F.coalesce(F.col("lang").isin(known), F.lit(False))}
    return _store(t, "documents", t("documents"), "doc_id", parts, n, among)


_PLACED = "o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"offset\", CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS part, text FROM documents)"


@query(f"""WITH {_PLACED}, i AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS "offset", 'items' AS part, text FROM benchmark), c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS "offset", 'turns' AS part, text FROM conversations),
 {_grams_sql('d', 'o', '"offset", part', 8)}, {_grams_sql('b', '(SELECT * FROM i UNION ALL SELECT * FROM c)', '"offset", part', 8)}
 SELECT ngram, d."offset", d.part, b."offset" AS other_offset, b.part AS other_part FROM d JOIN b USING (ngram)""")
def gram_store_matches(t):
    """Two benchmarks, items and turns, against one store of documents; each takes the n-grams that the other may have."""
    both = t("benchmark").select("text").unionByName(t("conversations").select("text"))
    store = _documents_store(t, 8, corpus.asked_side(both, t("documents"), 8))
    among = store.gram_side()
    asked = GramStore(store.spark, f"asked_{uuid.uuid4().hex}", 8, 16)
    asked.append(numbered(t("benchmark"), "item_id"), "items", among=among)
    asked.append(numbered(t("conversations").withColumn("id", F.struct("conv_id", "turn")), "id"), "turns", among=among)
    removed(among[0])
    return store.matches(asked)


@query(f"WITH {_PLACED}, {_grams_sql('d', 'o', chr(34) + 'offset' + chr(34), 13)} SELECT ngram, count(*) AS docs FROM d GROUP BY ngram HAVING count(*) > 3")
def gram_store_frequent(t):
    hashes = corpus.frequent_hashes(t("documents"), 13, 3)
    return _documents_store(t, 13, corpus.gram_side(hashes, hashes.count())).frequent(3)


# ---- bootstrap
@query(f"""WITH s AS (SELECT lang, doc_id, quality AS g, toxic AS p FROM labels JOIN documents USING (doc_id)), {weights_sql('s', 'doc_id', 1000)},
 c AS (SELECT lang, b, sum(w) FILTER (g = 1 AND p = 1) AS tp, sum(w) FILTER (g = 1 AND p = 0) AS fn, sum(w) FILTER (g = 0 AND p = 1) AS fp, sum(w) FILTER (g = 0 AND p = 0) AS tn FROM wt GROUP BY lang, b HAVING sum(w) > 0),
 z AS (SELECT lang, b, coalesce(tp, 0)::DOUBLE AS tp, coalesce(fn, 0)::DOUBLE AS fn, coalesce(fp, 0)::DOUBLE AS fp, coalesce(tn, 0)::DOUBLE AS tn FROM c),
 m AS (SELECT lang, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tn + fn)) * sqrt((tp + fn) * (tn + fp)), 0), 0) AS mcc FROM z)
 SELECT lang, round(stddev_samp(f1), 6) AS f1_stderr, round(stddev_samp(mcc), 6) AS mcc_stderr FROM m GROUP BY lang""")
def bootstrap_pair_errors(t):
    s = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("lang", "doc_id", F.col("quality").alias("gold"), F.col("toxic").alias("pred"))
    of = lambda kind: bootstrap.bootstrap_pairs(s, ["lang"], kind, 1000, positive=1).select("lang", r6("stderr").alias(f"{kind}_stderr"))
    return of("f1").join(of("mcc"), "lang")


def _row_counts_sql(name: str, form: str, grams: str, order: int) -> str:
    """Weighted sums of each class k, order n and replicate b: clipped matches m and the n-grams of either side, p and r."""
    side = lambda c: f"SELECT conv_id, turn, n, '{c}' AS side, {grams} AS gram FROM (SELECT conv_id, turn, {form.format(c)} AS x FROM p), (SELECT unnest(range(1, {order + 1})) AS n)"
    return f"""{name}_g AS (SELECT conv_id, turn, n, side, gram, count(*) AS c FROM ({side('pred')} UNION ALL {side('gold')}) GROUP BY ALL),
 {name}_m AS (SELECT conv_id, turn, n, sum(least(a.c, b.c)) AS m FROM {name}_g a JOIN {name}_g b USING (conv_id, turn, n, gram) WHERE a.side = 'pred' AND b.side = 'gold' GROUP BY ALL),
 {name}_t AS (SELECT conv_id, turn, n, coalesce(sum(c) FILTER (side = 'pred'), 0) AS p, coalesce(sum(c) FILTER (side = 'gold'), 0) AS r FROM {name}_g GROUP BY ALL),
 {name} AS (SELECT conv_id % 4 AS k, n, b, sum(w * coalesce(m, 0)) AS m, sum(w * p) AS p, sum(w * r) AS r FROM {name}_t LEFT JOIN {name}_m USING (conv_id, turn, n) JOIN wt USING (conv_id, turn) GROUP BY ALL)"""


@query(f"""WITH {_PAIRS}, {weights_sql('p', 'conv_id * 1000 + turn', 100)}, {_row_counts_sql('a', "list_filter(regexp_split_to_array(" + _TOKENS + ", '\\s+'), lambda t: t <> '')", _OF_TOKENS, 4)}, {_row_counts_sql('l', _LETTERS, _OF_LETTERS, 6)},
 x AS (SELECT k, b, CASE WHEN count(*) FILTER (m > 0) = 4 THEN 100 * exp(avg(ln(m / p)) FILTER (m > 0) + least(0, 1 - max(r) FILTER (n = 1) / max(p) FILTER (n = 1))) ELSE 0 END AS bleu FROM a GROUP BY k, b),
 y AS (SELECT k, b, avg(m / p) AS u, avg(m / r) AS v FROM l WHERE p > 0 AND r > 0 GROUP BY k, b)
 SELECT k, round(stddev_samp(bleu), 6) AS bleu_stderr, round(stddev_samp(coalesce(500 * u * v / nullif(4 * u + v, 0), 0)), 6) AS chrf_stderr FROM x JOIN y USING (k, b) GROUP BY k""")
def bootstrap_translation_errors(t):
    p = _pairs(t).select(F.pmod("conv_id", F.lit(4)).alias("k"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "pred", "gold")
    of = lambda kind: bootstrap.bootstrap_pairs(p, ["k"], kind, 1000).select("k", r6("stderr").alias(f"{kind}_stderr"))
    return of("bleu").join(of("chrf"), "k")


# ---- prompts
_PROMPTS = PromptLibrary(
    {
        "page:notice": {
            "prompt": "{% if lang == 'en' %}Text{% elif lang in ['de', 'fr'] %}{{ lang | upper }} text{% else %}Other{% endif %} of {{ source }}{% if n_chars > 2000 %}, {{ n_chars // 1000 }} thousand characters{% endif %}:\n{{ text[:80] }}...\nNext:",
            "target": "{{ text[80:100] }}",
            "choices": ["yes", "no"],
        },
        "page:words": {
            "prompt": "{% set w = text.split(' ') %}{% for x in w[:5] %}{{ loop.index }}. {{ x | lower }}{{ ', ' if not loop.last else '.' }}{% endfor %}",
            "target": "{{ text.split(' ') | length | string }}",
            "choices": "{{ text.split(' ')[:3] }}",
        },
        "chat:next": {
            "prompt": "{%- for m in messages -%}\n{{ m.role | capitalize }}: {{ m.content | replace('.', '!') }}\n{% endfor -%}\nAssistant:",
            "target": "{{ messages | length - 1 }}",
            "last": "{{ messages[-1].content ~ '|' ~ (messages | first).role }}",
        },
    }
)


@query("""WITH w AS (SELECT *, string_split(text, ' ') AS w FROM documents),
 a AS (SELECT doc_id, 'page:notice' AS prompt_name, CASE WHEN lang = 'en' THEN 'Text' WHEN lang IN ('de', 'fr') THEN upper(lang) || ' text' ELSE 'Other' END || ' of ' || source || CASE WHEN n_chars > 2000 THEN ', ' || (n_chars // 1000) || ' thousand characters' ELSE '' END || ':' || chr(10) || substring(text, 1, 80) || '...' || chr(10) || 'Next:' AS prompt,
   substring(text, 81, 20) AS target, ['yes', 'no'] AS choices FROM w),
 b AS (SELECT doc_id, 'page:words' AS prompt_name, array_to_string(list_transform(w[:5], lambda x, i: i || '. ' || lower(x) || CASE WHEN i = least(len(w), 5) THEN '.' ELSE ', ' END), '') AS prompt, len(w)::VARCHAR AS target, w[:3] AS choices FROM w)
 SELECT * FROM a UNION ALL SELECT * FROM b""")
def prompt_library(t):
    d = t("documents")
    return _PROMPTS.apply_all(d, "page:*").select("doc_id", "prompt_name", "prompt", "target", "choices")


@query("""SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || replace(text, '.', '!'), chr(10) ORDER BY turn) || chr(10) || 'Assistant:' AS prompt, count(*) - 1 AS target, arg_max(text, turn) || '|' || arg_min(role, turn) AS last FROM conversations GROUP BY conv_id""")
def chat_prompts(t):
    return _PROMPTS.apply(R.chat(t("conversations")), "chat:next").select("conv_id", "prompt", "target", "last")


# ---- JSON schemas
_SCHEMAS = {
    "typed": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}, "additionalProperties": False},
    "ranged": {"type": "object", "properties": {"k": {"anyOf": [{"minimum": 10, "exclusiveMaximum": 50}, {"enum": [3, 5, 7]}, {"multipleOf": 9}]}}},
    "nested": {"type": "object", "required": ["id", "items"], "properties": {"id": {"type": ["integer", "null"], "not": {"multipleOf": 7}}, "items": {"type": "array", "minItems": 2, "uniqueItems": True, "items": {"$comment": "two of them", "type": "object", "properties": {"k": {"type": "number", "minimum": 20}}}}, "kind": {"type": "string", "pattern": "^[a-m]", "maxLength": 8}}},
}


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END AS p, (props->>'k')::BIGINT AS k, event_id % 3 > 0 AS ok FROM events)
 SELECT event_type, count(*) AS n, round(avg(ok::INT), 6) AS typed, round(avg((ok AND (k BETWEEN 10 AND 49 OR k IN (3, 5, 7) OR k % 9 = 0))::INT), 6) AS ranged,
 round(avg((event_id % 7 > 0 AND k >= 20 AND event_type[1] BETWEEN 'a' AND 'm' AND length(event_type) <= 8)::INT), 6) AS nested FROM e GROUP BY event_type""")
def json_schema_compliance(t):
    props = F.when(F.col("event_id") % 3 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    nested = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "items": ['), F.col("props"), F.lit(', {"k": 1000}]}'))
    share = lambda text, name: r6(F.avg(complies(text, _SCHEMAS[name]).cast("int"))).alias(name)
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), share(props, "typed"), share(props, "ranged"), share(nested, "nested"))


# ---- lines of text
@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
 o AS (SELECT sum(strlen(line) + 1) OVER (ORDER BY doc_id, i) - strlen(line) - 1 AS place, line FROM l) SELECT place::BIGINT AS place, strlen(line) AS bytes, md5(line) AS line_md5 FROM o""")
def text_line_places(t):
    """The lines of all documents, written in two appends as text files, and read back by ranges of bytes that heed no line's border."""
    lines = t("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    spark, half = lines.sparkSession, t("documents").agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0] or 0
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    for part in (F.col("doc_id") <= half, F.col("doc_id") > half):
        append_lines(lines.where(part).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "i").select("line"), path)
    return read_lines(spark, path, 100_000).select("place", F.octet_length("line").alias("bytes"), F.md5("line").alias("line_md5"))


# ---- code lines
@query()
def code_line_similarity(t):
    """Each page's first line that is no comment against those of the two pages after it by page_id, whatever ids are missing, the first page following the last."""
    p = numbered_rows(t("pages").select("page_id", similarity.first_code_line(F.col("html")).alias("line")), "page_id", "line")
    n = F.lit(max(p.count(), 1))
    before = F.array(F.pmod(F.col("offset") - 1, n), F.pmod(F.col("offset") - 2, n))
    near = p.select("line", F.explode(before).alias("offset")).groupBy("offset").agg(F.collect_list("line").alias("golds"))
    return p.join(near, "offset").select("page_id", similarity.line_similarity(F.col("line"), F.col("golds")).alias("score"))


# ---- long contexts
@query("""WITH w AS (SELECT sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS total, count(*) FILTER (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 0) AS n FROM documents)
 SELECT item_id, budget, depth, true AS within, true AS whole, true AS at_depth, text AS question, true AS same FROM benchmark, w, (VALUES (3000), (20000)) AS b(budget), (VALUES (0), (50), (100)) AS d(depth)""")
def packed_long_contexts(t):
    """Benchmark items as needles among documents; checks that hold for every row, and the question split back from the prompt."""
    docs, items = t("documents"), t("benchmark")
    c = long_context.packed(items, "item_id", "text", docs, "doc_id", [3000, 20000], [0, 50, 100]).join(items, "item_id")
    ask = ("Read the texts.", "Answer:")
    parts = long_context.split_prompt(long_context.prompt(F.col("input"), F.col("text"), *ask), *ask)
    n = lambda x: F.size(text.words(x))
    before = F.col("before_words")
    longest = docs.agg(F.max(n(F.col("text")))).first()[0] or 0
    at_depth = (before * 100 <= F.col("depth") * F.col("context_words")) & ((before + longest) * 100 >= F.col("depth") * F.col("context_words"))
    whole = n(F.col("input")) == F.col("context_words") + n(F.col("text"))
    within = (F.col("context_words") <= F.col("budget")) & (F.col("context_words") + 2 * longest >= F.col("budget"))
    return c.select("item_id", F.col("budget").cast("int").alias("budget"), "depth", within.alias("within"), whole.alias("whole"), at_depth.alias("at_depth"), parts["question"].alias("question"), (parts["context"] == F.col("input")).alias("same"))


# ---- sentences
_Q = sentences.AROUND.replace("'", "''")
_XLOG = lambda n, p: f"CASE WHEN {n} = 0 THEN 0 ELSE ({n}) * ln({p}) END"


def _tokens_sql(name: str, rows: str, key: str) -> str:
    """CTEs up to name (key, word, period, mark, next, big)."""
    return f"""{name}_w AS (SELECT {key}, list_transform({tokens_sql('text')}, lambda x: trim(x, '{_Q}')) AS w FROM {rows}),
 {name}_x AS (SELECT {key}, unnest(w) AS x, unnest(list_append(w[2:], NULL)) AS y FROM {name}_w WHERE len(w) > 0),
 {name} AS (SELECT {key}, lower(CASE WHEN x LIKE '%.' THEN x[:-2] ELSE x END) AS word, x LIKE '%.' AS period, coalesce(regexp_matches(x, '[?!]$'), false) AS mark, lower(regexp_replace(y, '[.,;:?!]+$', '')) AS next, coalesce(y[1] <> lower(y[1]), false) AS big FROM {name}_x)"""


_MODEL_SQL = f"""{_tokens_sql('t', 'documents', 'doc_id')}, z AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (period) AS p FROM t),
 c AS (SELECT word, count(*) AS n, count(*) FILTER (period) AS p FROM t GROUP BY word HAVING regexp_matches(word, '\\p{{L}}')),
 ab AS (SELECT word FROM (SELECT word, c.n, c.p, length(replace(word, '.', '')) AS l, length(word) AS m, z.p / z.n AS q FROM c, z WHERE c.p > 0)
  WHERE -2 * ({_XLOG('p', 'q')} + {_XLOG('n - p', '1 - q')} - ({_XLOG('p', '0.99')} + {_XLOG('n - p', '1 - 0.99')})) * exp(-l) * (m - l + 1) * pow(l::DOUBLE, -(n - p)) >= 0.3),
 st AS (SELECT next AS word, count(*)::DOUBLE AS s FROM t WHERE (mark OR period) AND next <> '' AND word NOT IN (SELECT word FROM ab) GROUP BY next),
 b AS (SELECT word, c.n::DOUBLE AS w, s, (SELECT sum(s) FROM st) AS a, z.n AS n FROM c JOIN st USING (word), z),
 sr AS (SELECT word FROM b WHERE w >= s AND n / a > w / s AND -2 * ({_XLOG('s', 'w / n')} + {_XLOG('a - s', '1 - w / n')} + {_XLOG('w - s', 'w / n')} + {_XLOG('(n - a - w + s)', '1 - w / n')}
  - CASE WHEN s = a THEN 0 ELSE {_XLOG('s', 's / a')} + {_XLOG('a - s', '1 - s / a')} END - CASE WHEN w = s THEN 0 ELSE {_XLOG('w - s', '(w - s) / (n - a)')} + {_XLOG('(n - a - w + s)', '1 - (w - s) / (n - a)')} END) >= 30)"""


def _sentences_sql(name: str, rows: str, key: str) -> str:
    border = "mark OR NOT (word IN (SELECT word FROM ab) OR regexp_full_match(word, '\\p{L}|\\p{N}+')) OR (big AND next IN (SELECT word FROM sr))"
    return f"""{_tokens_sql(name + '_t', rows, key)}, {name} AS (SELECT {key}, 1 + count(*) FILTER (next IS NOT NULL AND (mark OR period) AND ({border})) AS sentences FROM {name}_t GROUP BY {key})"""


@query(f"WITH {_MODEL_SQL}, u AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), {_sentences_sql('s', 'u', 'id')} SELECT id, sentences FROM s")
def sentence_counts(t):
    """Sentences of each turn, by what all documents teach of abbreviations and starters."""
    turns = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return sentences.sentence_counts(turns, "id", sentences.fit(t("documents")))


_STRIPPED = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_FORMS = "string_split(text, chr(10))"


@query(f"""WITH {_MODEL_SQL}, d AS (SELECT doc_id, lang, text, {_FORMS} AS l FROM documents),
 f AS (SELECT doc_id, lang, 0 AS i, text FROM d UNION ALL SELECT doc_id, lang, 1, {_STRIPPED.format("array_to_string(l[2:], chr(10))")} FROM d UNION ALL SELECT doc_id, lang, 2, {_STRIPPED.format("array_to_string(l[:len(l) - 1], chr(10))")} FROM d
  UNION ALL SELECT doc_id, lang, 3, {_STRIPPED.format("CASE WHEN len(l) > 2 THEN array_to_string(l[2:len(l) - 1], chr(10)) ELSE '' END")} FROM d),
 g AS (SELECT doc_id * 10 + i AS id, text FROM f UNION ALL SELECT doc_id * 10 + 4 + i, replace(text, '*', '') FROM f), {_sentences_sql('s', 'g', 'id')},
 h AS (SELECT id, len(list_filter({tokens_sql('text')}, lambda w: upper(w) = w AND lower(w) <> w)) AS big, len({tokens_sql('text')}) > 0 AS filled FROM g),
 j AS (SELECT id // 10 AS doc_id, bool_or(sentences >= 12) FILTER (id % 10 = 0) AS strict, bool_or(sentences >= 12) AS loose FROM s GROUP BY 1),
 k AS (SELECT id // 10 AS doc_id, bool_or(filled AND big < 1) FILTER (id % 10 = 0) AS cs, bool_or(filled AND big < 1) AS cl FROM h GROUP BY 1)
 SELECT lang, round(avg(coalesce(strict, false)::INT), 6) AS sentences_strict, round(avg(coalesce(loose, false)::INT), 6) AS sentences_loose, round(avg(cs::INT), 6) AS capitals_strict, round(avg(cl::INT), 6) AS capitals_loose FROM documents LEFT JOIN j USING (doc_id) JOIN k USING (doc_id) GROUP BY lang""")
def sentence_and_capital_instructions(t):
    """At least twelve sentences, and no word of capitals, strictly and loosely."""
    d = t("documents")
    model = sentences.fit(d)
    many = sentences.enough_sentences_both(d, "doc_id", F.lit(12), F.lit("at least"), model)
    out = many.withColumnsRenamed({"strict": "s_strict", "loose": "s_loose"})
    capitals = {}
    for name, loose in (("strict", False), ("loose", True)):
        capital = scoring.instructions_followed(F.col("text"), F.array(F.lit("change_case:capital_word_frequency")), F.array(F.lit('{"capital_frequency": 1, "capital_relation": "less than"}')), loose)
        capitals[f"c_{name}"] = F.get(capital, 0)
    out = d.select("doc_id", "lang", *[c.alias(name) for name, c in capitals.items()]).join(out, "doc_id")
    share = lambda c, name: r6(F.avg(F.col(c).cast("int"))).alias(name)
    return out.groupBy("lang").agg(share("s_strict", "sentences_strict"), share("s_loose", "sentences_loose"), share("c_strict", "capitals_strict"), share("c_loose", "capitals_loose"))


# ---- groups of several metrics
@query("""WITH s AS (SELECT source AS task, quality, toxic FROM labels JOIN documents USING (doc_id)),
 r AS (SELECT task, 'acc' AS metric, avg(quality) AS v, stddev_samp(quality) / sqrt(count(*)) AS e, count(*) AS n FROM s GROUP BY task UNION ALL SELECT task, 'toxic', avg(toxic), stddev_samp(toxic) / sqrt(count(*)), count(*) FROM s GROUP BY task),
 g AS (SELECT CASE WHEN substr(task, 4)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, * FROM r UNION ALL SELECT 'all', * FROM r)
 SELECT grp AS "group", 'none' AS filter, metric, round(CASE WHEN metric = 'acc' OR grp = 'all' THEN sum(v * n) / sum(n) ELSE avg(v) END, 6) AS value, round(CASE WHEN count(e) = count(*) THEN sqrt(sum((n - 1) * e * e * n) / (sum(n) - count(*)) / sum(n)) END, 6) AS stderr, sum(n)::BIGINT AS n
 FROM g WHERE grp <> 'all' OR metric = 'toxic' GROUP BY grp, metric""")
def group_rollup_several(t):
    """Two metrics a group, weighted by size and not, and one of both groups."""
    d = t("labels").join(t("documents").select("doc_id", F.col("source").alias("task")), "doc_id")
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v")) for m, c in (("acc", "quality"), ("toxic", "toxic"))]))
    samples = d.select("task", F.lit("none").alias("filter"), "doc_id", pairs)
    two = [{"metric": "acc"}, {"metric": "toxic", "weight_by_size": False, "aggregation": "mean"}]
    names = {"even": [f"src{i}" for i in range(0, 20, 2)], "odd": [f"src{i}" for i in range(1, 20, 2)]}
    configs = {g: {"group": g, "task": members, "aggregate_metric_list": two} for g, members in names.items()} | {"all": {"group": "all", "task": ["even", "odd"], "aggregate_metric_list": {"metric": "toxic"}}}
    r = group_results(task_results(samples), catalog.groups(configs))
    return r.withColumns({"value": r6("value"), "stderr": r6("stderr")})


# ---- common runs
@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, {tokens_sql("regexp_replace(lower(pred), '([一-龥]|[[:punct:]])', ' \\1 ', 'g')")} AS a, {tokens_sql("regexp_replace(lower(gold), '([一-龥]|[[:punct:]])', ' \\1 ', 'g')")} AS b FROM p),
 x AS (SELECT conv_id, turn, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM w), y AS (SELECT conv_id, turn, unnest(b) AS t, generate_subscripts(b, 1) AS j FROM w),
 d AS (SELECT conv_id, turn, i - j AS d, i - row_number() OVER (PARTITION BY conv_id, turn, i - j ORDER BY i) AS r FROM x JOIN y USING (conv_id, turn, t)),
 m AS (SELECT conv_id, turn, max(k) AS k FROM (SELECT conv_id, turn, d, r, count(*) AS k FROM d GROUP BY ALL) GROUP BY conv_id, turn)
 SELECT conv_id, turn, coalesce(k, 0) AS run, round(coalesce(2.0 * k / nullif(len(a) + len(b), 0), 0), 6) AS f1 FROM w LEFT JOIN m USING (conv_id, turn)""")
def common_run_scores(t):
    """Each turn against the next by the longest run of tokens that both have."""
    tokens = lambda c: common_runs.mixed_tokens(F.lower(c), r"[\p{Punct}]")
    p = _pairs(t).withColumns({"a": tokens("pred"), "b": tokens("gold")})
    return p.select("conv_id", "turn", common_runs.longest_common_run(F.col("a"), F.col("b")).alias("run"), r6(common_runs.common_run_f1(F.col("a"), F.col("b"))).alias("f1"))


@query()
def document_common_runs(t):
    """Each whole document against the next by doc_id, the first one following the last, by the longest run of words that both have."""
    d = numbered(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", "offset", text.words(F.col("text")).alias("w"))
    nxt = d.select(F.pmod(F.col("offset") - 1, F.lit(max(d.count(), 1))).alias("offset"), F.col("w").alias("v"))
    return d.join(nxt, "offset").select("doc_id", common_runs.longest_common_run(F.col("w"), F.col("v")).alias("run"))


# ---- right and wrong texts
_SIDES = f"""q AS (SELECT conv_id, turn, text AS pred, [lead(text) OVER o, lead(text, 2) OVER o] AS a, [lag(text) OVER o] AS b FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
 r AS (SELECT conv_id, turn, kind, i, pred, ref FROM (SELECT conv_id, turn, pred, true AS kind, unnest(a) AS ref, generate_subscripts(a, 1) AS i FROM q UNION ALL SELECT conv_id, turn, pred, false, unnest(b), 1 FROM q) WHERE ref IS NOT NULL)"""
_ALNUM = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _pair_counts_sql(name: str, form: str, order: int) -> str:
    """(conv_id, turn, kind, i, n, m, p, r) of every pair of texts."""
    side = lambda c: f"SELECT conv_id, turn, kind, i, n, '{c}' AS side, {_OF_TOKENS} AS gram FROM (SELECT conv_id, turn, kind, i, {form.format(c)} AS x FROM r), (SELECT unnest(range(1, {order + 1})) AS n)"
    keys = "conv_id, turn, kind, i, n"
    return f"""{name}_g AS (SELECT {keys}, side, gram, count(*) AS c FROM ({side('pred')} UNION ALL {side('ref')}) GROUP BY ALL),
 {name}_m AS (SELECT {keys}, sum(least(a.c, b.c)) AS m FROM {name}_g a JOIN {name}_g b USING ({keys}, gram) WHERE a.side = 'pred' AND b.side = 'ref' GROUP BY ALL),
 {name}_t AS (SELECT {keys}, sum(c) FILTER (side = 'pred') AS p, sum(c) FILTER (side = 'ref') AS r FROM {name}_g GROUP BY ALL),
 {name} AS (SELECT {keys}, coalesce(m, 0) AS m, coalesce(p, 0) AS p, coalesce(x.r, 0) AS r FROM (SELECT * EXCLUDE (pred, ref) FROM r, (SELECT unnest(range(1, {order + 1})) AS n)) LEFT JOIN {name}_t x USING ({keys}) LEFT JOIN {name}_m USING ({keys}))"""


@query(f"""WITH {_SIDES}, {_pair_counts_sql('w', "list_filter(regexp_split_to_array(" + _TOKENS + ", '\\s+'), lambda t: t <> '')", 4)}, {_pair_counts_sql('l', _ALNUM, 2)},
 z AS (SELECT *, count(*) FILTER (m = 0) OVER (PARTITION BY conv_id, turn, kind, i ORDER BY n) AS k FROM w),
 u AS (SELECT conv_id, turn, kind, i, CASE WHEN max(m) > 0 AND min(p) > 0 THEN 100 * exp(avg(ln(CASE WHEN m = 0 THEN pow(2.0, -k) ELSE m END / nullif(p, 0))) + least(0, 1 - max(r) FILTER (n = 1) / nullif(max(p) FILTER (n = 1), 0))) ELSE 0 END AS bleu FROM z GROUP BY ALL),
 v AS (SELECT conv_id, turn, kind, i, max(200.0 * m / nullif(p + r, 0)) FILTER (n = 1) AS r1, max(200.0 * m / nullif(p + r, 0)) FILTER (n = 2) AS r2 FROM l GROUP BY ALL),
 s AS (SELECT conv_id, turn, max(bleu) FILTER (kind) AS ba, max(bleu) FILTER (NOT kind) AS bb, max(coalesce(r1, 0)) FILTER (kind) AS xa, max(coalesce(r1, 0)) FILTER (NOT kind) AS xb, max(coalesce(r2, 0)) FILTER (kind) AS ya, max(coalesce(r2, 0)) FILTER (NOT kind) AS yb FROM u JOIN v USING (conv_id, turn, kind, i) GROUP BY conv_id, turn)
 SELECT conv_id, turn, round(ba, 5) AS bleu_max, round(ba - bb, 5) + 0.0 AS bleu_diff, (ba > bb)::INT::DOUBLE AS bleu_acc, round(xa - xb, 5) + 0.0 AS rouge1_diff, round(ya - yb, 5) + 0.0 AS rouge2_diff FROM s""")
def right_and_wrong_texts(t):
    """Each turn against the two after it as right, and the one before it as wrong answers."""
    o = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last())
    c = t("conversations").select(F.struct("conv_id", "turn").alias("id"), "text", F.array(F.lead("text").over(o), F.lead("text", 2).over(o)).alias("a"), F.array(F.lag("text").over(o)).alias("b"))
    c = c.where("id.conv_id IS NOT NULL AND id.turn IS NOT NULL")  # neighbours like any other, but no rows of the result, as in the SQL
    x = answers.text_contrast(c, "id", "text", "a", "b")
    r5 = lambda c: F.round(c, 5) + 0.0  # noqa: E731  no negative zeros
    return x.select("id.conv_id", "id.turn", r5("bleu.best").alias("bleu_max"), r5("bleu.difference").alias("bleu_diff"), F.col("bleu.acc").alias("bleu_acc"), r5("rouge1.difference").alias("rouge1_diff"), r5("rouge2.difference").alias("rouge2_diff"))


# ---- answers inside of responses
_CLEARED = r"regexp_replace(lower(regexp_replace(text, '[0-9]+', '', 'g')), '\\p{P}', '', 'g')"
_FOUND = "regexp_extract(' ' || t || ' ', '[^\\p{L}\\p{N}_](of|de|von|and|et|und|y)[^\\p{L}\\p{N}_]', 1)"  # this dialect's word borders know ASCII only


@query(f"""WITH c AS (SELECT conv_id, turn, {_CLEARED} AS t FROM conversations), f AS (SELECT conv_id, turn, {_FOUND} AS x FROM c)
 SELECT conv_id, turn, CASE WHEN x IN ('of', 'de', 'von') THEN 'owned' WHEN x <> '' THEN 'joined' ELSE '[invalid]' END AS answer FROM f""")
def filter_map_ignoring(t):
    """Responses lower-cased, without punctuation and digits, mapped by the first word that a pattern finds."""
    f = families.map_regex({r"\b(?:of|de|von)\b": "owned", r"\b(?:and|et|und|y)\b": "joined"}, ignore_case=True, ignore_punctuation=True, regexes_to_ignore=["[0-9]+"])
    return t("conversations").select("conv_id", "turn", F.get(f(F.array("text")), 0).alias("answer"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) - length(replace(text, '$', '')) > 1 THEN regexp_extract(text, '(?s)\\$(.*)\\$', 1) ELSE text END) AS answer_md5 FROM documents""")
def dollar_answers(t):
    return t("documents").select("doc_id", F.md5(scoring.between_dollars(F.col("text"))).alias("answer_md5"))
