"""Substring dedup: compressed FM-indexes per shard, matching statistics of streamed runs by backward search.

Two equal windows of WINDOW words have the same anchor, the least hash of their GRAM-word grams (of equal ones, the
last). A run is the windows of a document around one anchor, at most WINDOW - GRAM + 1 of them. Runs go to their
anchor's shard, so a shard holds every window that can equal one of its own and no document is streamed past
another's shard. Anchors of a single run repeat nothing and stay behind. Each shard indexes its runs, of equal
ones two, and streams the distinct ones through the index. An anchor with over HOT_RUNS distinct runs would overfill a
shard: its runs are cut into single windows, which are dealt to shards by their own hash instead (of windows, too, those
whose hash is alone stay behind), indexed and streamed in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, pieces, small_side, text_bytes, word_hashes
from .fmindex import FMIndex, repeats

WINDOW, GRAM, HOT_RUNS, SHARD_WORDS = 35, 12, 4096, 800_000
SEEN, HOT_BROADCAST = 100_000, 100_000
_B = 0x9E3779B97F4A7C15


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k consecutive values, modulo 2**64, by doubling."""
    done, length, power, at = None, 0, h, 1
    while True:
        if k & at:
            if done is None:
                done, length = power, at
            else:
                n = len(h) - length - at + 1
                done, length = done[:n] + np.uint64(pow(_B, length, 1 << 64)) * power[length : length + n], length + at
        if length == k:
            break
        power = power[: len(power) - at] + np.uint64(pow(_B, at, 1 << 64)) * power[at:]
        at *= 2
    x = done ^ (done >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _sliding_min(v: np.ndarray, k: int) -> np.ndarray:
    at = 1
    while 2 * at <= k:
        v = np.minimum(v[: len(v) - at], v[at:])
        at *= 2
    return np.minimum(v[: len(v) - (k - at)], v[k - at :]) if k > at else v


def anchored_runs(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: anchor, text, first window and number of windows of each run."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    grams = _grams(hashes, GRAM)
    span = WINDOW - GRAM + 1
    low = _sliding_min(grams, span)
    turn = np.ones(len(low), bool)
    turn[1:] = (low[1:] != low[:-1]) | (grams[span:] == low[1:])
    ends = np.cumsum(words)
    per = np.maximum(words - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(words)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    window = place + np.repeat(ends - words, per)
    first = np.flatnonzero(turn[window] | (place == 0))
    return low[window[first]], text[first], place[first], np.diff(first, append=len(window))


def _anchors(batches):
    for batch in batches:
        for b in pieces(batch, 2, 1 << 20):
            a, text, start, count = anchored_runs(*word_hashes(b.column(2).to_pylist()))
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(a)), b.column(0).take(row), b.column(1).take(row), pa.array(start, pa.int32()), pa.array(count, pa.int8())], ["a", "k1", "k2", "start", "count"])


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """128-bit digests as two columns of long."""
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(x[:, k])) for k in (0, 1)]


class _Twice:
    """Says which of equal texts are the first two since the last reset: no more are needed where a task meets many."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, digest: bytes) -> bool:
        if len(self.seen) > SEEN:
            self.seen.clear()
        n = self.seen[digest] = self.seen.get(digest, 0) + 1
        return n <= 2


def _joined(data: bytes) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins (and one past the end)."""
    words = data.split()
    return b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, dtype=np.int64) if words else np.zeros(0, np.int64)


def _cut(batches):
    """Runs by 128-bit hash, with their words where a task has not met them twice."""
    wanted, digest = _Twice(), xxhash.xxh3_128_digest
    for batch in batches:
        for b in pieces(batch, 2, 1 << 20):
            runs = b.column(3).flatten()
            start, count = (runs.field(x) for x in ("start", "count"))
            of = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
            found, texts, last = [], [], -1
            for k, s, n in zip(of.tolist(), start.to_pylist(), count.to_pylist()):
                if k != last:
                    text, end = _joined(b.column(2)[k].as_py())
                    end, last = [0, *end.tolist()], k
                run = text[end[s] : end[s + n + WINDOW - 1] - 1]
                d = digest(run)
                found.append(d)
                texts.append(run if wanted(d) else None)
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays([runs.field("a"), *_halves(found), b.column(0).take(row), b.column(1).take(row), start, pa.array(texts, pa.binary())], ["a", "r1", "r2", "k1", "k2", "start", "run"])


def _laid_out(runs: list[bytes], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs' words as numbers from 1, each run so many times, a 0 after each; where each run first begins; its length."""
    words = pc.split_pattern(pa.array(runs, pa.large_binary()).cast(pa.large_string()), " ")
    ids = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    length = words.value_lengths().to_numpy().astype(np.int64)
    again = np.repeat(np.arange(len(runs)), times)
    size = length[again] + 1
    base = np.cumsum(size) - size
    at = np.repeat((np.cumsum(length) - length)[again] - base, size) + np.arange(size.sum())
    text = ids[np.minimum(at, len(ids) - 1)]
    text[base + size - 1] = 0
    return text, base[np.cumsum(times) - times], length


def _search(batches):
    """One shard: index its runs, of equal ones two, then stream each distinct one."""
    known: dict[tuple, int] = {}
    runs, times = [], []
    for b in batches:
        for r1, r2, run in zip(*(c.to_pylist() for c in b.columns)):
            k = known.setdefault((r1, r2), len(runs))
            if k == len(runs):
                runs.append(run)
                times.append(1)
            else:
                times[k] = 2
    if not runs:
        return
    text, begin, length = _laid_out(runs, np.array(times))
    del runs
    found = repeats(FMIndex(text), text, begin, begin + length, WINDOW)
    keys = np.array(list(known), np.int64)[[i for i, _, _ in found]].reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), pa.array([s for _, s, _ in found], pa.int64()), pa.array([t for _, _, t in found], pa.int64())], ["r1", "r2", "s", "t"])


def _windows(batches):
    """Every window of runs by 128-bit hash, with its words where a task has not met them twice."""
    wanted, digest = _Twice(), xxhash.xxh3_128_digest
    for batch in batches:
        for b in pieces(batch, 2, 1 << 18):
            found, texts, of, at = [], [], [], []
            for k, run in enumerate(b.column(2).to_pylist()):
                text, end = _joined(run)
                end = [0, *end.tolist()]
                for s in range(len(end) - WINDOW):
                    w = text[end[s] : end[s + WINDOW] - 1]
                    d = digest(w)
                    found.append(d)
                    texts.append(w if wanted(d) else None)
                    of.append(k)
                    at.append(s)
            row = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*_halves(found), b.column(0).take(row), b.column(1).take(row), pa.array(at, pa.int32()), pa.array(texts, pa.binary())], ["w1", "w2", "r1", "r2", "s", "run"])


def _searched(runs: DataFrame, by: str) -> DataFrame:
    """(r1, r2, s, t): what the shards of runs (by, r1, r2, run), dealt by a column, find repeated."""
    words = runs.agg(F.sum(F.length("run"))).first()[0] or 0
    shards = max(runs.sparkSession.sparkContext.defaultParallelism, words // 7 // SHARD_WORDS + 1)
    return runs.repartition(shards, by).select("r1", "r2", "run").mapInArrow(_search, "r1 long, r2 long, s long, t long")


def _keep(batches):
    for batch in batches:
        for b in pieces(batch, 1):
            total, gone, kept = [], [], []
            for data, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = data.split()
                left, at = [], 0
                for s, t in sorted((x["s"], x["t"]) for x in spans or ()):
                    if s > at:
                        left += words[at:s]
                    at = max(at, t)
                left += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(k1, k2, spans): word intervals covered by repeated windows; keyed has (k1, k2, data), equal keys for equal rows only."""
    anchors = materialize(keyed.select("k1", "k2", "data").mapInArrow(_anchors, "a long, k1 long, k2 long, start int, count byte"), "substring-anchors")
    # Written, so that the joins are free to split what an anchor or a run of very many rows puts in one partition.
    shared = materialize(anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "substring-shared")
    hits = materialize(anchors.join(shared, "a", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "start", "count")).alias("runs")), "substring-hits")
    discard(anchors, shared)
    cut = keyed.join(hits, ["k1", "k2"]).select("k1", "k2", "data", "runs").mapInArrow(_cut, "a long, r1 long, r2 long, k1 long, k2 long, start int, run binary")
    runs = materialize(cut, "substring-runs")
    discard(hits)
    texts = runs.where("run IS NOT NULL").select("a", "r1", "r2", "run")
    crowded = texts.select("a", "r1", "r2").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_RUNS).select("a")
    hot = materialize(crowded, "substring-hot")
    if hot.isEmpty():
        found = materialize(_searched(texts, "a"), "substring-found")
    else:
        some = small_side(hot, HOT_BROADCAST)
        found = _searched(texts.join(some, "a", "left_anti"), "a")
        windows = materialize(texts.join(some, "a", "left_semi").select("r1", "r2", "run").mapInArrow(_windows, "w1 long, w2 long, r1 long, r2 long, s int, run binary"), "substring-windows")
        single = windows.where("run IS NOT NULL").select("w1", "w2", "run")
        again = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
        again = materialize(single.join(again, ["w1", "w2"], "left_semi").withColumnsRenamed({"w1": "r1", "w2": "r2"}), "substring-again")
        seen = _searched(again, "r1").select(F.col("r1").alias("w1"), F.col("r2").alias("w2")).distinct()
        placed = windows.select("w1", "w2", "r1", "r2", "s").distinct().join(seen, ["w1", "w2"], "left_semi").select("r1", "r2", F.col("s").cast("long"), (F.col("s") + WINDOW).cast("long").alias("t"))
        found = materialize(found.unionByName(placed), "substring-found")
        discard(windows, again)
    per_run = materialize(found.groupBy("r1", "r2").agg(F.collect_set(F.struct("s", "t")).alias("parts")), "substring-parts")
    discard(hot, found)
    spans = runs.select("k1", "k2", "start", "r1", "r2").join(per_run, ["r1", "r2"]).select("k1", "k2", F.transform("parts", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["t"] + F.col("start")).alias("t"))).alias("parts"))
    spans = materialize(spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("parts")).alias("spans")), "substring-spans")
    discard(runs, per_run)
    return spans


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: kept are the words left, joined by one space.

    A word goes if any window of WINDOW words over it is a word sequence that starts anywhere else too, in
    the input as it stands. A null text has no words. Repeated rows repeat all their windows, so all of those go. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", text_bytes().alias("data")).withColumns({"k1": F.xxhash64("doc_id", "data"), "k2": F.xxhash64("data", F.lit(1), "doc_id")})
    spans = repeated_spans(keyed)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans").mapInArrow(_keep, f"doc_id {kind}, n_words long, n_removed long, kept string")
