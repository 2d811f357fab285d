"""The corpus operators' queries over the driver's tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, line_dedup, lm_score, merkle, minhash, mixing, periodic, pieces, quality, quality_rules, simhash, substring_dedup
from .common import BLANKS, table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels"))).drop("lines")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.sample(table(spark, sf_dir, "documents"), TOKENIZER)
    return rows.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", "round_trip")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sizes_mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.array_join(F.col("mix_shards").cast("array<string>"), ",").alias("shards"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not tampered with."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", ascii_uppercase, ascii_lowercase)))
    rows = merkle.prove(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered")))
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.digest(proof).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id leaves its words as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    g = F.floor(F.col("h") / 10)

    def looped(words):
        n = F.size(words)
        first = g % n
        period = 1 + F.floor((n - first) / (3 + g % 8))
        bounds = F.struct(first.cast("int").alias("a"), period.cast("int").alias("p"))
        new = lambda b: F.transform(words, lambda w, i: F.when(i < b["a"], w).otherwise(F.get(words, b["a"] + (i - b["a"]) % b["p"])))
        return F.when(n > 0, F.array_join(F.get(F.transform(F.array(bounds), new), F.lit(0)), " ")).otherwise("")

    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    text = F.when(F.col("h") % 10 == 0, F.get(F.transform(F.array(words), looped), F.lit(0))).otherwise(F.col("text"))  # bound to lambda variables, or worked out again for each word
    rows = periodic.find_runs(docs.select("doc_id", text.alias("text")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic.best_run(F.col("runs")).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_simhash, op3_minhash, op4_langid, op5_quality, op6_quality_rules, op7_pieces, op8_substring_dedup, op9_line_dedup, op10_mixing, op11_bpe, op12_merkle, op13_periodic)}


def _tree_sql(name: str, levels: int = 6) -> str:
    """Levels over {name}_0 (g, pos, n, node), each with the digests left and right in its run, and {name}_root (g, node)."""
    up = [f"{name}_{k} AS (SELECT g, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}_{k - 1} WHERE n > 1 GROUP BY g, pos // 16, n)" for k in range(1, levels + 1)]
    beside = lambda rows: f"coalesce(string_agg(node, '') OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN {rows}), '')"
    side = [f"{name}_s{k} AS (SELECT g, pos, n, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}_{k} WHERE n > 1)" for k in range(levels)]
    root = " UNION ALL ".join(f"SELECT g, node FROM {name}_{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*up, *side, f"{name}_root AS ({root})"])


def _path_sql(name: str, of: str, node: str, levels: int = 6) -> tuple[str, str, str]:
    """The joins of a node's runs, the text of its siblings, and the fold of a node over them."""
    joins = "".join(f" LEFT JOIN {name}_s{k} ON {name}_s{k}.g = {of}.g AND {name}_s{k}.pos = {of}.pos // {16 ** k}" for k in range(levels))
    for k in range(levels):
        node = f"CASE WHEN {name}_s{k}.n > 1 THEN sha256({name}_s{k}.l || {node} || {name}_s{k}.r) ELSE {node} END" if k == 0 else f"(SELECT CASE WHEN {name}_s{k}.n > 1 THEN sha256({name}_s{k}.l || x || {name}_s{k}.r) ELSE x END FROM (SELECT {node} AS x))"
    return joins, " || ".join(f"coalesce({name}_s{k}.l || {name}_s{k}.r, '')" for k in range(levels)), node


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    joins, proof, folded = _path_sql("a", "l", "coalesce(l.tampered, l.leaf)")
    more, upper, whole = _path_sql("b", "t", "half.folded")
    return f"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS (SELECT *, xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substring(doc_id::VARCHAR, k, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
        l AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN h % 5 = 0 THEN {leaf(lower)} END AS tampered, count(*) OVER (PARTITION BY source) AS n,
              row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS pos FROM d),
        a_0 AS (SELECT g, pos, n, leaf AS node FROM l), {_tree_sql("a")},
        t AS (SELECT '' AS g, g AS name, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a_root),
        b_0 AS (SELECT g, pos, n, node FROM t), {_tree_sql("b")},
        half AS (SELECT l.*, {proof} AS proof, {folded} AS folded FROM l{joins})
        SELECT doc_id, leaf, t.node AS subroot, b_root.node AS root, sha256(proof || {upper}) AS proof_sha256, {whole} AS folded_root, {whole} = b_root.node AS verified
        FROM half JOIN t ON half.g = t.name{more} CROSS JOIN b_root"""


def oracle_sql() -> dict[str, str]:
    bare = "trim({}, chr(32) || chr(9) || chr(13))"
    return {
        "op12_merkle": _merkle_sql(),
        "op9_line_dedup": f"""
            WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
            seen AS (SELECT DISTINCT doc_id, source, {bare.format("u.line")} AS line FROM pages, unnest(lines) AS u(line)),
            total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
            bad AS (SELECT s.source, s.line FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source WHERE s.line <> ''
                    GROUP BY s.source, s.line, t.pages HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > {line_dedup.RATIO} * t.pages),
            hosts AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
            kept AS (SELECT p.doc_id, p.text, p.lines, CASE WHEN h.bad IS NULL THEN p.lines ELSE
                     list_filter(p.lines, lambda x: NOT list_contains(h.bad, {bare.format("x")})) END AS kept
                     FROM pages p LEFT JOIN hosts h ON p.source IS NOT DISTINCT FROM h.source)
            SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
                   CASE WHEN text IS NOT NULL THEN sha256(coalesce(array_to_string(kept, chr(10)), '')) END AS kept_sha256 FROM kept""",
    }
