"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

A word is a run of letters. Its score for a language is the sum of the log-probabilities of
its letter trigrams (blanks at its ends), counted over every training document and hashed to
a fixed number of buckets. Languages rarely written in a word's script are no candidates for it.
The best path over a document's words pays SWITCH for each change of language.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces

BUCKETS, SWITCH, SMOOTH, SCRIPT_SHARE, CHUNK = 1 << 15, 8.0, 0.1, 1e-3, 4096
# First code point of each script range, and the script it begins (Unicode blocks).
SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other")]
NAMES = sorted({name for _, name in SCRIPTS})


@cache
def _tables():
    """Is a letter, and lower-case form if that is one code point, of every code point."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if len(x := c.lower()) == 1:
                lower[i] = ord(x)
    return letter, lower, np.array([a for a, _ in SCRIPTS]), np.array([NAMES.index(n) for _, n in SCRIPTS])


def _words(texts: list[str]):
    """Of the texts laid end to end with a blank after each: trigram buckets of the letters, each word's first letter (index among letters) and first position, its script and its text."""
    letter, lower, edges, scripts = _tables()
    code = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    c = np.where(is_letter, lower[code], 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    if not len(at):
        return None
    before, after = np.concatenate([[0], c[:-1]]).astype(np.uint64), np.concatenate([c[1:], [0]]).astype(np.uint64)
    mixed = (before[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after[at] * np.uint64(0x165667B19E3779F9))
    bucket = ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(49)).astype(np.int64)  # 15 bits
    first = np.flatnonzero(before[at] == 0)
    start = at[first]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return bucket, first, start, scripts[np.searchsorted(edges, code[start], "right") - 1], np.searchsorted(ends, start, "right"), ends


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for b in pieces(batch, 0):
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                if found := _words([t for t, x in zip(texts, langs) if x == lang]):
                    bucket, first, _, script, _, _ = found
                    n = totals.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    n[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(script, weights=np.diff([*first, len(bucket)]), minlength=len(NAMES)).astype(np.int64)
    for lang, n in totals.items():
        (k,) = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n[k])], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> dict:
    """Counts over all rows with a text and a lang, summed by Spark; the driver gets at most BUCKETS + scripts numbers a language."""
    bounded_batches(docs.sparkSession)
    counts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    n = np.zeros((len(langs), BUCKETS + len(NAMES)))
    n[[langs.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(int)] = rows["n"]
    grams, script = n[:, :BUCKETS] + SMOOTH, n[:, BUCKETS:]
    allowed = script > SCRIPT_SHARE * script.sum(1, keepdims=True)
    allowed |= ~allowed.any(0)  # a script no language has shuts out none
    return {"langs": langs, "scores": np.ascontiguousarray(np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)), "allowed": allowed.T}


def viterbi(score: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best path over (words, languages) scores with a fixed price for each change; ties keep the language, then take the first.

    The recurrence runs over plain lists, CHUNK words at a time: on a few languages that beats array calls per word.
    """
    n, k = score.shape
    back = np.empty((n, k), np.int32)
    v = score[0].tolist()
    for a in range(1, n, CHUNK):
        seen = []
        for own in score[a : a + CHUNK].tolist():
            seen.append(v)
            moved = max(v) - switch
            v = [(x if x >= moved else moved) + s for x, s in zip(v, own)]
        before = np.array(seen)
        back[a : a + CHUNK] = np.where(before >= before.max(1, keepdims=True) - switch, np.arange(k), before.argmax(1)[:, None])
    path = np.empty(n, np.int32)
    at = path[-1] = int(np.argmax(v))
    for a in range(((n - 2) // CHUNK) * CHUNK + 1, 0, -CHUNK):
        labels = []
        for row in reversed(back[a : a + CHUNK].tolist()):
            at = row[at]
            labels.append(at)
        path[a - 1 : a - 1 + len(labels)] = labels[::-1]
    return path


def _label(texts: list[str], model: dict, switch: float = SWITCH):
    """Per text: (language, share of letters, spans). One language is best throughout if no run of words gains more than half a switch with another: k such runs pay k - 1 switches at least."""
    out = [("und", 0.0, []) for _ in texts]
    found = _words(texts) if model["langs"] else None
    if not found:
        return out
    bucket, first, start, script, doc, ends = found
    score = np.add.reduceat(model["scores"][bucket], first, axis=0).astype(np.float64)
    score[~model["allowed"][script]] -= 1e4
    size = np.diff([*first, len(bucket)])
    docs, lo = np.unique(doc, return_index=True)
    hi = [*lo[1:], len(doc)]
    best = np.add.reduceat(score, lo, axis=0).argmax(1)
    label = np.repeat(best, np.diff([*lo, len(doc)]))
    gain = score - score[np.arange(len(doc)), label][:, None]
    upto = np.cumsum(gain, axis=0)
    apart = np.repeat(np.arange(len(docs)), np.diff([*lo, len(doc)]))[:, None] * (4 * np.abs(upto).max() + 1)
    rise = np.maximum.reduceat((upto - apart) - np.minimum.accumulate(upto - gain - apart, axis=0), lo, axis=0).max(1)
    for i in np.flatnonzero(rise > switch / 2):
        label[lo[i] : hi[i]] = viterbi(score[lo[i] : hi[i]], switch)
    for k, d in enumerate(docs):
        own, weight = label[lo[k] : hi[k]], size[lo[k] : hi[k]]
        share = np.bincount(own, weights=weight, minlength=len(model["langs"]))
        at = start[lo[k] : hi[k]] - (ends[d - 1] if d else 0)
        turn = np.flatnonzero(np.diff(own, prepend=-1))
        last = [*(turn[1:] - 1), len(own) - 1]
        spans = [(model["langs"][own[a]], int(at[a]), int(at[b] + weight[b])) for a, b in zip(turn, last)]
        out[d] = (model["langs"][int(share.argmax())], float(share.max() / share.sum()), spans)
    return out


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row.

    spans are (lang, start, end) in code points of the text, from a first to a last letter.
    lang_pred has most letters (ties: first by name) and score is its share of them. A text that is null
    or has no letter, and every text if nothing was learned, is 'und' with score 0 and no spans. Repeated rows
    each get a row, an empty table none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                got = _label([t or "" for t in b.column(1).to_pylist()], shared.value, switch)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                spans = pa.array([[{"lang": x, "start": s, "end": e} for x, s, e in g[2]] for g in got], kind)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), spans], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")
