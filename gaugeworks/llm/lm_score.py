"""LM scoring by masked pseudo-likelihood.

A bidirectional window network in numpy predicts every word from the two before and the two after it: embeddings, a tanh
layer and a softmax in two steps, over classes and over the leaves of a class. The most frequent words are leaves
themselves; the others share a leaf with the words of like ending and length, of which each has its share of the leaf's
occurrences. The summed conditional log-probabilities score a document.

Words are lower-cased (A-Z) and counted exactly, by 64-bit hash, in a table that grows with the distinct words. Only its
head (a number that grows with the root of the vocabulary, up to MAX_TOP) and a total per leaf go to the tasks; the counts of
all other words stay a table, joined to the words of each document. Classes and leaves grow with the vocabulary too. Documents
are dealt by hash of their id and text to trainers, whose number hangs on the size of the corpus alone; in each of ROUNDS rounds
every trainer fits the network to its part from the same start, and the results are averaged by words (local SGD), so scores
do not hang on how the table is laid out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, pieces, text_bytes, word_hashes

#: CLASSES and TOP hold up to VOCABULARY distinct words; beyond, they grow as grown() says.
VOCABULARY, CLASSES, TOP, MAX_TOP = 1 << 17, 48, 1 << 16, 1 << 20
DIM, HIDDEN, SIDE = 8, 24, 2
BATCH, RATE, SEED, ROUNDS, TRAINER_BYTES, MAX_TRAINERS = 8192, 0.2, 5, 2, 12 << 20, 4096
SLICE, SEGMENT, BLOCK, SMOOTH, ROWS = 1 << 20, 1 << 16, 1 << 10, 0.1, 2016


def grown(words: int) -> tuple[int, int]:
    """(classes, words whose counts go to the tasks) for a number of distinct words."""
    by = max(1.0, words / VOCABULARY)
    return round(CLASSES * by**0.125), min(round(TOP * by**0.5), MAX_TOP)


def start(classes: int = CLASSES, seed: int = SEED) -> list[np.ndarray]:
    """Embeddings of leaves (the first is beyond a text's ends), tanh layer and its bias, classes, leaves of each class (biases in the last rows)."""
    r = np.random.default_rng(seed)
    draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    out = [(r.standard_normal((classes * classes + 1, DIM)) * 0.3).astype(np.float32), draw(2 * SIDE * DIM, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN + 1, classes), draw(classes, HIDDEN + 1, classes) * np.float32(0.3)]
    out[3][-1], out[4][:, -1] = 0, 0
    return out


def coded(texts: list[bytes], shape: dict) -> tuple[np.ndarray, ...]:
    """Of the words of texts: leaf, log of the share of the leaf (but for the count of words beyond the head), hash, whether it is beyond the head; and the number of words of each text."""
    h, size, ending = word_hashes([t.lower() for t in texts], endings=True)
    leaf = shape["own"] + ending.astype(np.int64) % shape["classes"]
    share = -np.log(shape["total"])[leaf - shape["own"]]
    if len(shape["head"]) and len(h):
        import pandas as pd

        which, known = pd.factorize(h)
        at = np.minimum(np.searchsorted(shape["head"], known), len(shape["head"]) - 1)
        hit = shape["head"][at] == known
        of = at[which]
        inside = hit[which]
        own = inside & (shape["leaf"][of] >= 0)
        leaf = np.where(own, shape["leaf"][of], leaf)
        share = np.where(own, 0.0, share + np.where(inside, np.log(shape["n"][of] + SMOOTH), 0.0))
    else:
        inside = np.zeros(len(h), bool)
    return leaf, share, h, ~inside, size


def _segments(size: np.ndarray):
    """(first text, last, first word, last) of whole texts, about SEGMENT words at a time."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        before = ends[a] - size[a]
        b = max(a + 1, int(np.searchsorted(ends, before + SEGMENT, side="right")))
        yield a, b, int(before), int(ends[b - 1])
        a = b


def around(leaf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Embedding rows of the words beside each, SIDE to either side of it in its text."""
    at = np.arange(len(leaf)) + SIDE * (1 + np.repeat(np.arange(len(size)), size))
    ctx = np.zeros(len(leaf) + SIDE * (len(size) + 1), np.uint16 if len(leaf) and leaf.max() < 65534 else np.int32)
    ctx[at] = leaf + 1
    return np.stack([ctx[at + k] for k in range(-SIDE, SIDE + 1) if k], 1)


def _powers(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of h @ w, no number of h beyond 1, and what to divide its rows by: the greatest logit is only looked for where one could overflow."""
    z = h @ w
    if np.abs(w).sum(0).max() > 80:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32)


def _errors(h: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Softmax of h @ w, less 1 at each row's place."""
    z, total = _powers(h, w)
    z *= (1 / total)[:, None]
    z[np.arange(len(z)), at] -= 1
    return z


def _chosen(h: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Softmax of h @ w at each row's place; so many rows at a time that the logits stay in the cache."""
    out = np.empty(len(h), np.result_type(h, w))
    for a in range(0, len(h), ROWS):
        z, total = _powers(h[a : a + ROWS], w)
        np.divide(z[np.arange(len(z)), at[a : a + ROWS]], total, out=out[a : a + ROWS])
    return out


def _hidden(p: list[np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The layer's inputs and outputs, with a 1 after these."""
    x = p[0].take(ctx.ravel(), axis=0).reshape(len(ctx), -1)
    h = np.ones((len(x), HIDDEN + 1), np.float32)
    y = x @ p[1]
    y += p[2]
    np.tanh(y, out=h[:, :-1])
    return x, h


def _by_class(leaf: np.ndarray, classes: int) -> tuple:
    """Rows in the order of their classes; class and place within it of each, in the rows' own order; (class, first row, last) in turn."""
    cls, place = np.divmod(leaf, classes)
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    ordered = cls[order]
    cut = [0, *(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1).tolist(), len(cls)]
    return order, cls, place, [(int(ordered[a]), a, b) for a, b in zip(cut, cut[1:]) if b > a]


def log_probs(p: list[np.ndarray], ctx: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Of each word's leaf given the words around it."""
    order, cls, place, runs = _by_class(leaf, p[3].shape[1])
    h, got = np.empty((len(leaf), HIDDEN + 1), np.float32), np.empty(len(leaf))
    for a in range(0, len(leaf), ROWS):
        h[a : a + ROWS] = _hidden(p, ctx[a : a + ROWS])[1]
    got[:] = _chosen(h, p[3], cls)
    h, got, place = h.take(order, axis=0), got[order], place[order]
    for c, a, b in runs:
        got[a:b] *= _chosen(h[a:b], p[4][c], place[a:b])
    out = np.empty(len(leaf))
    out[order] = np.log(got + 1e-30)
    return out


class Trainer:
    """Adagrad on batches of words, over parameters that it changes."""

    def __init__(self, params: list[np.ndarray]):
        self.params, self.seen, self.words = params, [np.full_like(x, 1e-2) for x in params], 0

    def _step(self, k: int, g: np.ndarray, at=...) -> None:
        s = self.seen[k][at]
        s += g * g
        if at is not ...:
            self.seen[k][at] = s
        self.params[k][at] -= RATE * g / np.sqrt(s)

    def gradients(self, ctx: np.ndarray, leaf: np.ndarray) -> list[tuple]:
        """Of the mean negative log-probability: (parameter, gradient, rows it is of). Rows are taken in the order of their classes, so each class's lie together."""
        p, n = self.params, len(leaf)
        order, cls, place, runs = _by_class(leaf, p[3].shape[1])
        ctx, cls, place = ctx.take(order, axis=0), cls[order], place[order]
        x, h = _hidden(p, ctx)
        d = _errors(h, p[3], cls)
        dh = d @ p[3][:-1].T
        of_leaves = np.zeros_like(p[4])
        for c, a, b in runs:
            dc = _errors(h[a:b], p[4][c], place[a:b])
            dh[a:b] += dc @ p[4][c, :-1].T
            np.matmul(h[a:b].T, dc, out=of_leaves[c])
        of_leaves /= n
        slope = h[:, :-1] ** 2
        np.subtract(1, slope, out=slope)
        slope /= n
        dh *= slope
        dx = (dh @ p[1].T).reshape(-1, DIM)
        flat = ctx.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        return [(3, h.T @ d / n, ...), (4, of_leaves, ...), (1, x.T @ dh, ...), (2, dh.sum(0), ...), (0, np.add.reduceat(dx.take(order, axis=0), first, axis=0), flat[first])]

    def fit(self, leaf: np.ndarray, size: np.ndarray) -> None:
        for a, b, lo, hi in _segments(size):
            part = leaf[lo:hi]
            ctx = around(part, size[a:b])
            for i in range(0, len(part), BATCH):
                for k, g, at in self.gradients(ctx[i : i + BATCH], part[i : i + BATCH]):
                    self._step(k, g, at)
        self.words += len(leaf)


def score_texts(texts: list[bytes], model: dict) -> tuple[np.ndarray, ...]:
    """(number of words, summed log-probability but for the counts of words beyond the head, hashes of these words, their number) of each text, in one process."""
    leaf, share, h, rare, size = coded(texts, model["shape"])
    out = np.zeros(len(size))
    for a, b, lo, hi in _segments(size):
        if hi > lo:
            lp = log_probs(model["params"], around(leaf[lo:hi], size[a:b]), leaf[lo:hi]) + share[lo:hi]
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), size[a:b]), weights=lp, minlength=b - a)
    count = np.bincount(np.repeat(np.arange(len(size)), size)[rare], minlength=len(size)) if len(h) else np.zeros(len(size), int)
    return size, out, h[rare], count


def _count(batches):
    """(h, ending, n) of each slice's words."""
    import pandas as pd

    for batch in batches:
        for b in pieces(batch, 0, 8 * SLICE):
            h, _, ending = word_hashes([x.lower() for x in b.column(0).to_pylist()], endings=True)
            if len(h):
                which, known = pd.factorize(h)
                first = np.flatnonzero(which > np.maximum.accumulate(np.append(-1, which[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(ending[first].astype(np.int32)), pa.array(np.bincount(which))], ["h", "ending", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, ending, n): every distinct word of docs with its exact number of occurrences, as a written table."""
    bounded_batches(docs.sparkSession)
    counts = docs.select(text_bytes()).mapInArrow(_count, "h long, ending int, n long")
    return materialize(counts.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "lm-words")


def shaped(words: DataFrame) -> dict:
    """What the tasks need of the counts: the head's hashes, counts and leaves, and a total for each shared leaf.

    The head are the words with more occurrences than a threshold, the least that leaves at most grown() of them; of these, the first
    (by count, then hash) have leaves of their own. The driver gets a row for each different count, the head and a row a leaf.
    """
    levels = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("n", ascending=False)
    classes, top = grown(int(levels["words"].sum()))
    fits = levels["n"].to_numpy()[levels["words"].cumsum().to_numpy() <= top]
    least = int(fits[-1]) if len(fits) else 1 << 62
    head = words.where(F.col("n") >= least).toPandas().astype({"h": np.int64, "n": np.int64})
    own = classes * (classes - 1)
    head = head.assign(u=head["h"].to_numpy(np.int64).view(np.uint64)).sort_values(["n", "u"], ascending=[False, True], kind="stable").reset_index(drop=True)
    head["leaf"] = np.where(np.arange(len(head)) < own, np.arange(len(head)), -1)
    groups = words.groupBy(F.pmod("ending", F.lit(classes)).alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toPandas()
    total = np.full(classes, SMOOTH)
    total[groups["g"].to_numpy(int)] += groups["n"].to_numpy(float) + SMOOTH * groups["k"].to_numpy(float)
    mine = head["leaf"].to_numpy() >= 0
    np.subtract.at(total, head["ending"].to_numpy(int)[mine] % classes, head["n"].to_numpy(float)[mine] + SMOOTH)
    head = head.sort_values("u")
    return {"classes": classes, "sizes": (classes, top), "own": own, "head": head["u"].to_numpy(np.uint64), "n": head["n"].to_numpy(np.int64), "leaf": head["leaf"].to_numpy(np.int32), "total": np.maximum(total, SMOOTH)}


def _train(batches, params: list[np.ndarray], shape: dict):
    """(block, words, values): the trained parameters times the words seen, BLOCK numbers a row."""
    t = Trainer([x.copy() for x in params])
    for batch in batches:
        for b in pieces(batch, 0):
            leaf, *_, size = coded(b.column(0).to_pylist(), shape)
            t.fit(leaf, size)
    if t.words:
        x = np.concatenate([p.ravel() for p in t.params]).astype(np.float64) * t.words
        blocks = np.split(x, range(BLOCK, len(x), BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([t.words] * len(blocks), pa.int64()), pa.array([v.tobytes() for v in blocks], pa.binary())], ["block", "words", "x"])


def _mean(table: pa.Table) -> pa.Table:
    order = np.argsort(table["words"].to_numpy(), kind="stable")
    total = sum(np.frombuffer(table["x"][int(i)].as_buffer(), np.float64) for i in order)
    return pa.table([table["block"][:1], pa.array([(total / table["words"].to_numpy().sum()).astype(np.float32).tobytes()], pa.binary())], ["block", "x"])


def fit(docs: DataFrame) -> dict:
    """Exact counts and the averaged network from all rows of docs. The counts stay a table; the driver gets what shaped() says and the parameters."""
    spark = docs.sparkSession
    words = word_counts(docs)
    shape = shaped(words)
    # Dealt by content: the same rows reach the same trainer in the same order, however the input lies.
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), text_bytes().alias("data"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    trainers = min(MAX_TRAINERS, 1 + size // (ROUNDS * TRAINER_BYTES))
    params = start(shape["classes"])
    for turn in range(ROUNDS):
        begun = spark.sparkContext.broadcast((params, shape))
        part = keyed.where(F.pmod("key", F.lit(ROUNDS)) == turn).withColumn("trainer", F.pmod(F.shiftright("key", 8), F.lit(trainers)).cast("int"))
        part = part.repartitionById(trainers, "trainer").sortWithinPartitions("key").select("data")
        sums = part.mapInArrow(lambda batches, given=begun: _train(batches, *given.value), "block int, words long, x binary")
        got = sums.groupBy("block").applyInArrow(_mean, "block int, x binary").toPandas().sort_values("block")
        if len(got):
            mean, at = np.frombuffer(b"".join(map(bytes, got["x"])), np.float32), 0
            for k, p in enumerate(params):
                params[k] = mean[at : at + p.size].reshape(p.shape)
                at += p.size
    return {"params": params, "words": words, "shape": shape}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_words, log_prob, per_word) for every row; a text without words (or null) has log_prob 0 and a null per_word. Repeated rows each get a row, an empty table none."""
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("params", "shape")})

    def run(batches):
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for b in pieces(batch, 1, SLICE):
                n, lp, h, count = score_texts(b.column(1).to_pylist(), shared.value)
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(n))), b.column(0), pa.array(n, pa.int64()), pa.array(lp), rare], ["key", "doc_id", "n_words", "lp", "rare"])
                key += len(n)

    of = docs.schema["doc_id"].dataType.simpleString()
    scored = materialize(docs.select("doc_id", text_bytes()).mapInArrow(run, f"key long, doc_id {of}, n_words long, lp double, rare array<long>"), "lm-scored")
    rare = scored.select("key", F.explode("rare").alias("h"))
    least = int(model["shape"]["n"].min()) if len(model["shape"]["n"]) else 1 << 62
    counts = model["words"].where(F.col("n") < least).select("h", F.log(F.col("n") + SMOOTH).alias("share"))
    shares = rare.join(counts, "h", "left").groupBy("key").agg(F.sum(F.coalesce("share", F.lit(float(np.log(SMOOTH))))).alias("shares"))
    out = scored.drop("rare").join(shares, "key", "left").select("doc_id", "n_words", (F.col("lp") + F.coalesce("shares", F.lit(0.0))).alias("log_prob"))
    return out.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
