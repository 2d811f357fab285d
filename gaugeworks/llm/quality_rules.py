"""Quality rules: a linear-chain conditional random field over lines marks content or boilerplate by Viterbi decoding.

What share of a document's word characters stands in lines decoded as content decides whether it is retained, after the base
rules on words. The field is trained here, on lines of a bounded sample of labelled documents, towards labels of single
lines: a line that the whole corpus repeats between different neighbours is boilerplate (copies of a document repeat their lines
between the same ones); the other lines of good documents are content; which lines of bad documents are to
blame is found by expectation and maximisation, under the constraint that they hold most of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, pieces, text_bytes

MAX_LABELLED, MAX_CHAINS, CHAIN_LINES, SEED, STEPS, RIDGE, CONTENT_SHARE, BLAME = 2_000, 4_000, 256, 13, 60, 1e-3, 0.5, 0.6
MIN_CONTEXTS, CONTEXT_SHARE, COMMON_BROADCAST, PADDED = 5, 0.25, 200_000, 200_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FEATURES = ["bias", "log_chars", "word_length", "symbols", "upper", "digits", "bangs", "high", "no_stop", "repeated", "common"]
_SYMBOLS, _BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def base(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = data.split()
    n = len(words)
    solid = data.translate(None, _BLANKS)
    chars = len(solid) - int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANKS):
            seen.add(line)
    repeated = 0
    if n >= 4:
        index: dict[bytes, int] = {}
        x = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        v = len(index)
        pair = x[:-1] * v + x[1:]
        if v > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * v + x[2:]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[back] >= 2)
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[again + k] = True
        repeated = int(cover.sum())
    return n, chars, _without(data, _SYMBOLS), dup, repeated


def common_lines(docs: DataFrame) -> DataFrame:
    """A written table (h): hashes of the lines (without blanks at their ends) that stand between MIN_CONTEXTS different pairs of neighbours or more, and between different ones in CONTEXT_SHARE of their occurrences. Counted over all rows."""
    bare = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    h = F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.xxhash64(x))
    placed = F.transform(F.col("h"), lambda x, i: F.struct(x.alias("h"), F.xxhash64(F.get("h", i - 1), F.get("h", i + 1)).alias("c")))
    seen = docs.select(h.alias("h")).select(F.explode(placed).alias("x")).groupBy("x.h", "x.c").agg(F.count(F.lit(1)).alias("n"))
    lines = seen.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"))
    return materialize(lines.where((F.col("contexts") >= MIN_CONTEXTS) & (F.col("contexts") >= CONTEXT_SHARE * F.col("n"))).select("h"), "rules-common")


def _with_common(docs: DataFrame, common: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """docs plus __common, the hashes of its common lines, and None; or, where all common lines are few enough to broadcast, docs as they are and those."""
    few = common.limit(COMMON_BROADCAST + 1).toPandas()["h"].to_numpy(np.int64) if common.limit(COMMON_BROADCAST + 1).count() <= COMMON_BROADCAST else None
    if few is not None:
        return docs.withColumn("__common", F.lit(None).cast("array<long>")), few
    keyed = docs.withColumns({"__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), "text")})
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\x0b\x0c"))))
    hits = keyed.select("__k1", "__k2", F.explode(F.array_distinct(lines)).alias("h")).distinct().join(common, "h", "left_semi")
    hits = materialize(hits.groupBy("__k1", "__k2").agg(F.collect_set("h").alias("__common")), "rules-hits")
    return keyed.join(hits, ["__k1", "__k2"], "left").drop("__k1", "__k2").withColumn("__common", F.coalesce("__common", F.expr("cast(array() AS array<long>)"))), None


def line_features(data: bytes, common: set[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Features and word characters (bytes) of the lines that have a word."""
    rows, sizes, seen = [], [], set()
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        size, n = len(line), len(words)
        solid = sum(map(len, words))
        h = xxhash.xxh64_intdigest(line.strip(_BLANKS), 42)
        known = (h - (1 << 64) if h >> 63 else h) in common
        rows.append((1.0, np.log(size) / 4, solid / n / 10, _without(line, _SYMBOLS) / n, _without(line, _UPPER) / solid, _without(line, _DIGITS) / solid, line.count(b"!") / n, _without(line, bytes(range(128, 256))) / solid, float(words[-1][-1:] not in (b".", b"!", b"?")), float(line in seen), float(known)))
        sizes.append(solid)
        seen.add(line)
    return np.array(rows).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


class Chains:
    """Sequences of about equal length, padded to the longest: the field's likelihood and its gradient."""

    def __init__(self, x: list[np.ndarray]):
        self.length = np.array([len(v) for v in x])
        b, m = len(x), int(self.length.max())
        self.x = np.zeros((b, m, x[0].shape[1]))
        for i, rows in enumerate(x):
            self.x[i, : len(rows)] = rows
        self.mask = np.arange(m)[None] < self.length[:, None]

    def marginals(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each label of each line, expected number of each transition, log of the partition function."""
        b, m, _ = self.x.shape
        s = np.where(self.mask[..., None], self.x @ w, 0.0)
        a, back = np.zeros((b, m, 2)), np.zeros((b, m, 2))
        a[:, 0] = s[:, 0]
        for k in range(1, m):
            a[:, k] = np.logaddexp(a[:, k - 1, :1] + t[0], a[:, k - 1, 1:] + t[1]) + s[:, k]
        for k in range(m - 2, -1, -1):
            nxt = s[:, k + 1] + back[:, k + 1]
            to = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
            back[:, k] = np.where(self.mask[:, k + 1, None], to, 0.0)
        z = np.logaddexp(*(s[:, 0] + back[:, 0]).T)
        p = np.where(self.mask[..., None], np.exp(np.minimum(a + back - z[:, None, None], 0.0)), 0.0)
        pair = a[:, :-1, :, None] + t + (s[:, 1:] + back[:, 1:])[:, :, None] - z[:, None, None, None]
        return p, np.exp(np.minimum(pair, 0.0))[self.mask[:, 1:]].sum(0), z

    def gradient(self, w: np.ndarray, t: np.ndarray, y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of labels y, and that."""
        p, moves, z = self.marginals(w, t)
        gold, gt, ll = np.zeros_like(p), -moves, -z.sum()
        for i, v in enumerate(y):
            gold[i, np.arange(len(v)), v] = 1
            np.add.at(gt, (v[:-1], v[1:]), 1.0)
            ll += t[v[:-1], v[1:]].sum()
        ll += (gold * (self.x @ w)).sum()
        return np.einsum("bmf,bms->fs", self.x, gold - p), gt, float(ll)


def _buckets(x: list[np.ndarray]) -> list[tuple[np.ndarray, Chains]]:
    """Sequences by length, at most about PADDED lines with their padding together."""
    order, out, a = np.argsort([len(v) for v in x], kind="stable"), [], 0
    for b in range(1, len(order) + 1):
        if b == len(order) or (b + 1 - a) * len(x[order[b]]) > PADDED:
            out.append((order[a:b], Chains([x[i] for i in order[a:b]])))
            a = b
    return out


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, chained: bool = True) -> dict:
    """Maximum conditional likelihood by Adam over (features, label of each line); 1 is content. Unless chained, lines are independent."""
    sequences = [s for s in sequences if len(s[0])]
    w, t = np.zeros((sequences[0][0].shape[1] if sequences else len(FEATURES), 2)), np.zeros((2, 2))
    if not sequences or len({int(v) for _, y in sequences for v in y}) < 2:
        w[0, 1] = 1.0  # nothing says what boilerplate is
        return {"w": w, "t": t}
    buckets = _buckets([x for x, _ in sequences])
    lines = sum(len(x) for x, _ in sequences)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t)]
    for step in range(1, steps + 1):
        gw, gt = -RIDGE * w, -RIDGE * t
        for rows, chains in buckets:
            a, b, _ = chains.gradient(w, t, [sequences[i][1] for i in rows])
            gw, gt = gw + a / lines, gt + b / lines
        for param, grad, (m1, m2) in zip((w, t), (gw, gt if chained else gt * 0), moments):
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * grad * grad
            param += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return {"w": w, "t": t}


def blamed(p: np.ndarray, size: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Labels of a bad document's lines by their probability of content: the least likely go until BLAME of the characters are gone, of the rest those below one half."""
    y = (p >= 0.5).astype(np.int64)
    order = np.argsort(p, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    y[order[before < BLAME * size.sum()]] = 0
    y[common] = 0
    return y


def learn(documents: list[tuple[np.ndarray, np.ndarray, bool]], steps: int = STEPS) -> dict:
    """A field from (features, sizes, good) of chains of lines: independent lines first, then two rounds of the field with the bad documents' lines labelled anew."""
    documents = [d for d in documents if len(d[0])]
    common = [x[:, FEATURES.index("common")] > 0 for x, _, _ in documents]
    y = [np.where(c, 0, int(good)) for c, (_, _, good) in zip(common, documents)]
    model = fit([(x, v) for (x, _, _), v in zip(documents, y)], steps, chained=False)
    for _ in range(2):
        for rows, chains in _buckets([x for x, _, _ in documents]) if documents else ():
            p = chains.marginals(model["w"], model["t"])[0][..., 1]
            for i, row in zip(rows, p):
                x, size, good = documents[i]
                if not good:
                    y[i] = blamed(row[: len(x)], size, common[i])
        model = fit([(x, v) for (x, _, _), v in zip(documents, y)], steps)
    return model


def decode(x: np.ndarray, model: dict) -> list[int]:
    """Viterbi path, 1 for content; ties go to content."""
    s = (x @ model["w"]).tolist()
    (t00, t01), (t10, t11) = model["t"].tolist()
    v0, v1 = s[0]
    back = []
    for e0, e1 in s[1:]:
        b0, b1 = int(v1 + t10 >= v0 + t00), int(v1 + t11 >= v0 + t01)
        back.append((b0, b1))
        v0, v1 = (v1 + t10 if b0 else v0 + t00) + e0, (v1 + t11 if b1 else v0 + t01) + e1
    path = [int(v1 >= v0)]
    for pair in reversed(back):
        path.append(pair[path[-1]])
    return path[::-1]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> dict:
    """The field, and the corpus's common lines as a table.

    Labelled documents: the max_labelled least by hash; their texts are cut into chains of CHAIN_LINES lines, of which the MAX_CHAINS least by
    hash are learned from (the documented bounds of the sample). Several labels of one document are averaged.
    """
    common = common_lines(docs)
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    rows, few = _with_common(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text"), common)

    def lines(batches):
        every = frozenset(few.tolist()) if few is not None else None
        for batch in batches:
            for b in pieces(batch, 2):
                out = []
                for d, y, data, own in zip(*(c.to_pylist() for c in b.columns)):
                    x, size = line_features(data, every if every is not None else set(own))
                    for k in range(0, len(x), CHAIN_LINES):
                        out.append((xxhash.xxh64_intdigest(f"{d},{k}", seed) >> 1, y, x[k : k + CHAIN_LINES].ravel().tolist(), size[k : k + CHAIN_LINES].tolist()))
                kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["key", "y", "x", "size"])

    chains = rows.select("doc_id", "y", text_bytes().alias("text"), "__common").mapInArrow(lines, "key long, y double, x array<double>, size array<long>")
    chains = chains.orderBy("key", "y").limit(MAX_CHAINS).collect()
    return learn([(np.array(r.x).reshape(-1, len(FEATURES)), np.array(r.size), r.y >= 0.5) for r in chains]) | {"common": common}


def apply_rules(docs: DataFrame, model: dict, content_share: float = CONTENT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, lines, kept) for every row.

    lines has 1 or 0 (content or boilerplate) for each line with a word. A null or blank text has no
    words, fails the base rules and has content share 0. Repeated rows each get a row, an empty table none.
    """

    bounded_batches(docs.sparkSession)
    rows, few = _with_common(docs.select("doc_id", "text"), model["common"])
    shared = docs.sparkSession.sparkContext.broadcast((model["w"], model["t"], few))

    def run(batches):
        w, t, every = shared.value
        every = frozenset(every.tolist()) if every is not None else None
        for batch in batches:
            for b in pieces(batch, 1):
                rows = []
                for data, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    counts = base(data)
                    n, repeated = counts[0], counts[4]
                    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
                    x, sizes = line_features(data, every if every is not None else set(own))
                    path = decode(x, {"w": w, "t": t}) if len(x) else []
                    share = float((sizes * np.array(path)).sum() / sizes.sum()) if path else 0.0
                    rows.append((*counts, failed, share, path, not failed and share >= content_share))
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.int8()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "lines", "kept"])

    return rows.select("doc_id", text_bytes().alias("text"), "__common").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, lines array<byte>, kept boolean")
