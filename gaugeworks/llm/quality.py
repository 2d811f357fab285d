"""Quality classifier by hierarchical empirical Bayes.

A logistic model of text features gives each document's own evidence. Summed over a host and
over each of its paths (one grouped aggregation), that evidence gives site posteriors: the
host's rate is shrunk towards the global rate and the path's towards the host's, with
strengths estimated from the spread between sites, so sparse sites stay near the prior.
A document's log odds are its own evidence plus what its path says beyond the global rate, counted without itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, materialize, pieces, small_side, text_bytes

MAX_LABELLED, SEED, KEEP_FROM, SITES_BROADCAST, SALTS = 20_000, 11, 0.35, 50_000, 32
FEATURES = ["bias", "log_words", "word_length", "letters", "upper", "digits", "symbols", "bangs", "repeated_lines", "distinct_words", "log_line"]
MICRO = 1_000_000
_SYMBOLS = b"#*$%&|<>"


def features(text: str | bytes | None) -> list[float]:
    """Of one text; all but the bias are 0 if it has no words."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    size, n = len(data), len(words)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits, high = byte[65:91].sum(), byte[97:123].sum(), byte[48:58].sum(), byte[128:].sum()
    symbols = byte[list(_SYMBOLS)].sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = upper + lower + high
    return [1.0, np.log1p(n), (size - byte[32] - byte[9:14].sum()) / n / 10, letters / size, upper / max(letters, 1), digits / size, symbols / n, byte[33] / n, 1 - len(set(lines)) / len(lines), len(set(words)) / n, np.log1p(size / len(lines)) / 5]


def _features(batches):
    for batch in batches:
        for b in pieces(batch, 1):
            x = pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> dict:
    """Ridge logistic regression on the max_labelled labelled documents least by hash (the documented bound of the sample).

    Several labels of a document are averaged; null labels are ignored. Without labels, every document gets one half.
    """
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    rows = docs.join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(_features, "y double, x array<double>").toPandas()
    if not len(rows):
        return {"w": np.zeros(len(FEATURES)), "mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES))}
    x, y = np.stack(rows["x"].to_list()), rows["y"].to_numpy()
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return {"w": w, "mean": mean, "scale": scale}


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """docs plus evidence: the classifier's probability in millionths (long, so that sums don't hang on their order)."""
    bounded_batches(docs.sparkSession)
    w, b = model["w"] / model["scale"], -float((model["w"] * model["mean"] / model["scale"]).sum())

    @F.pandas_udf(T.LongType())
    def micro(texts):
        import pandas as pd

        z = np.array([np.dot(w, features(t)) for t in texts]) + b
        return pd.Series(np.rint(MICRO / (1 + np.exp(-np.clip(z, -12, 12)))).astype(np.int64))

    return docs.withColumn("evidence", micro(text_bytes()))


def sites(narrow: DataFrame) -> DataFrame:
    """(host, path, n_path, s_path, n_host, s_host, rate, k_host, k_path) from (source, lang, evidence): sums and shrinkage strengths."""
    path = narrow.groupBy(F.col("source").alias("host"), F.col("lang").alias("path")).agg(F.count(F.lit(1)).alias("n_path"), (F.sum("evidence") / MICRO).alias("s_path"))
    path = materialize(path, "quality-paths")
    host = path.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    both = materialize(path.alias("p").join(host.alias("h"), F.expr("p.host <=> h.host")).select("p.*", "n_host", "s_host"), "quality-sites")
    # Between-site variance by moments: the spread of site means less the spread that chance gives them. Three numbers for all sites.
    rate = both.agg(F.expr("coalesce((sum(s_path) + 0.5) / (sum(n_path) + 1), 0.5)")).first()[0]
    spread = lambda n, gap: F.greatest(F.lit(1e-6), (F.sum(n * gap * gap) - F.count(F.lit(1)) * rate * (1 - rate)) / F.sum(n))
    strength = lambda v: F.least(F.lit(1e4), F.greatest(F.lit(1.0), rate * (1 - rate) / v - 1))
    kh = host.agg(strength(spread(F.col("n_host"), F.col("s_host") / F.col("n_host") - rate))).first()[0]
    kp = both.agg(strength(spread(F.col("n_path"), F.col("s_path") / F.col("n_path") - F.col("s_host") / F.col("n_host")))).first()[0]
    discard(path)
    return both.withColumns({"rate": F.lit(rate), "k_host": F.lit(kh).cast("double"), "k_path": F.lit(kp).cast("double")})


def judge(rows: DataFrame, posteriors: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """rows (source, lang, evidence, ...) plus p_doc, p_host, p_path, score and kept."""
    columns = rows.columns
    side = small_side(posteriors, SITES_BROADCAST)
    on = "d.source <=> s.host AND d.lang <=> s.path"
    if side is posteriors:  # many sites: deal the rows of a large one over several tasks
        side = posteriors.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        on += " AND d.__salt = s.__salt"
    j = rows.alias("d").join(side.alias("s"), F.expr(on))
    p = F.col("d.evidence") / MICRO
    host = (F.col("s_host") - p + F.col("k_host") * F.col("rate")) / (F.col("n_host") - 1 + F.col("k_host"))
    host = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), host))
    path = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("s_path") - p + F.col("k_path") * host) / (F.col("n_path") - 1 + F.col("k_path"))))
    logit = lambda x: F.log(x / (1 - x))
    score = 1 / (1 + F.exp(-(logit(p) + logit(path) - logit(F.col("rate")))))
    j = j.select(*[F.col(f"d.`{c}`") for c in columns if c != "evidence"], p.alias("p_doc"), host.alias("p_host"), path.alias("p_path"), score.alias("score"))
    return j.withColumn("kept", F.col("score") >= keep_from)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_doc, p_host, p_path, score, kept) for every row of docs (doc_id, text, lang, source).

    The host is source, the path its part in one lang; nulls form groups of their own. A null text has no words. Repeated rows
    each count and get a row. Without labels every score is one half and all are kept; an empty table gives no rows.
    """
    narrow = materialize(evidence(docs.select("doc_id", "text", "lang", "source"), fit(docs, labels)).drop("text"), "quality-evidence")
    return judge(narrow, sites(narrow)).drop("source", "lang")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs. Evidence is worked out twice rather than shuffling texts."""
    model = fit(docs, labels)
    posteriors = sites(evidence(docs.select("doc_id", "text", "lang", "source"), model).select("source", "lang", "evidence"))
    clash = [c for c in docs.columns if c in ("evidence", "p_doc", "p_host", "p_path", "score", "kept")]
    rows = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    return judge(evidence(rows, model), posteriors).where("kept").select(*[F.col(f"__own_{c}" if c in clash else c).alias(c) for c in docs.columns])
