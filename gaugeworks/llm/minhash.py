"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

DataFrame functions only. Every five-word shingle is hashed once; the high bits choose one of
BINS bins and each bin keeps its least hash. An empty bin probes other bins in the order of its own
hash sequence until one is filled (optimal densification: the donors of two empty bins are independent). Of each
value the low BITS bits are stored; likeness takes the chance agreement of such codes off again.
"""

from __future__ import annotations

from functools import cache

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, discard, materialize

BINS, BITS, SHINGLE, SEED = 128, 8, 5, 42
GROUP, MAX_PARTS = 2048, 10_000  # ids of one window of following(), and the most windows


def _let(value: Column, body) -> Column:
    """body of value, worked out once: a lambda variable, unlike a column, isn't put in place of each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def probes() -> list[int]:
    """For each bin in turn, the other bins by the hash of (bin, other)."""
    return [k for i in range(BINS) for k in sorted((j for j in range(BINS) if j != i), key=lambda j: xxhash.xxh64_intdigest(f"{i},{j}".encode(), SEED))]


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - (BINS.bit_length() - 1)) + F.lit(BINS // 2)  # rises with x


def _codes_of(hashes: Column) -> Column:
    def firsts(s):
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def spread(f):
        code = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        at = lambda bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: code(F.get(f, F.array_position(bins, b).cast("int") - 1)))
        return F.when(F.size(f) == BINS, F.transform(f, code)).otherwise(_let(F.transform(f, lambda x: _bin(x).cast("int")), at))

    def densify(d):
        order = F.split(F.lit(",".join(map(str, probes()))), ",").cast("array<int>")  # folded to a constant
        probed = lambda i, k, n: F.get(F.filter(F.transform(F.sequence(i * (BINS - 1) + k, i * (BINS - 1) + n - 1), lambda t: F.get(d, F.get(order, t))), lambda v: v.isNotNull()), F.lit(0))
        donor = lambda i: F.coalesce(probed(i, 0, 4), probed(i, 4, 20), probed(i, 20, BINS - 1))
        return F.when(F.exists(d, lambda v: v.isNull()), F.transform(d, lambda x, i: F.coalesce(x, donor(i)))).otherwise(d)

    return _let(F.sort_array(hashes), lambda s: _let(firsts(s), lambda f: _let(spread(f), densify)))


def codes(text: Column) -> Column:
    """BINS codes of a text; null if it has no words. Fewer than five words make one shingle."""

    def shingles(w):
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        return F.when(n >= SHINGLE, many).otherwise(F.array(F.xxhash64(w)))

    plain = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, " ")))  # half the time of a pattern
    words = F.array_remove(F.when(F.rlike(text, F.lit(r"[\x09\x0B-\x0D]")), F.split(text, BLANKS)).otherwise(plain), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda w: F.when(F.size(w) > 0, _codes_of(shingles(w))))


def packed(c: Column) -> Column:
    """Hex digits of the codes; zeros for a text without words."""
    return F.coalesce(F.array_join(F.transform(c, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), ""), F.lit("0" * (BINS * BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two arrays of codes, less chance agreement: 1 if neither text has words, 0 if one has none."""
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / BINS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next greater of distinct non-null ids of a written table, null after the last.

    Ids are dealt by range (cut at quantiles that Spark samples) into parts of about GROUP, or more where that would make over MAX_PARTS,
    each a window; the last of a part takes the first of the next one, of which there is one row a part.
    """
    n = ids.count()
    if n <= GROUP:
        return ids.select("doc_id", F.lead("doc_id").over(Window.orderBy("doc_id")).alias("next_id"))
    cut = materialize(ids.select("doc_id").repartitionByRange(min(MAX_PARTS, n // GROUP + 1), "doc_id").withColumn("g", F.spark_partition_id()), "minhash-parts")
    inner = cut.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("g").orderBy("doc_id")))
    heads = cut.groupBy("g").agg(F.min("doc_id").alias("doc_id"))  # at most MAX_PARTS rows
    turn = heads.select("g", F.lead("doc_id").over(Window.orderBy("doc_id")).alias("head"))
    return inner.join(F.broadcast(turn), "g").select("doc_id", F.coalesce("next_id", "head").alias("next_id"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last quarter of code points replaced by as many (or all) of
    the first of the next document's, in the order of doc_id; the first follows the last. A null text counts as
    empty. Repeated doc_ids are one document to those before it, with their least text's beginning and their least
    fingerprint. A row without doc_id has no next document: its quarter is dropped and near_next is null. An empty table gives no rows.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = materialize(d.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("length(text) div 4").cast("long")).alias("q")), "minhash-ids")
    first = ids.agg(F.min("doc_id")).first()[0]
    nxt = materialize(following(ids.select("doc_id")).join(ids, "doc_id").select("doc_id", F.coalesce("next_id", F.lit(first)).alias("next_id"), "q"), "minhash-next")
    need = nxt.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "q")
    discard(ids)
    # Where need is small its join is broadcast and the texts move once; else they move for either join.
    starts = d.join(need, "doc_id", "left").select("for_id", F.substr("text", F.lit(1), F.col("q").cast("int")).alias("start")).groupBy("for_id").agg(F.min("start").alias("start"))
    q = F.expr("n_chars div 4").cast("int")
    both = d.join(starts, F.col("doc_id") == F.col("for_id"), "left").withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - q), F.coalesce(F.substr("start", F.lit(1), q), F.lit(""))))
    made = materialize(both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), codes(F.col("text")).cast("array<smallint>").alias("a"), codes(F.col("edited")).cast("array<smallint>").alias("e")), "minhash")
    other = made.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min(packed(F.col("a"))).alias("n"), F.min(F.col("a").isNull()).alias("blank"))
    unpacked = F.when(~F.col("blank"), F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.conv(F.substr("n", i * (BITS // 4) + 1, F.lit(BITS // 4)), 16, 10).cast("smallint")))
    out = made.join(nxt.select("doc_id", "next_id"), "doc_id", "left").join(other, "next_id", "left")
    near_next = F.when(F.col("next_id").isNotNull(), likeness(F.col("a"), F.col("u")))
    out = out.withColumn("u", unpacked)
    return out.select("doc_id", "n_chars", "edited_sha256", packed(F.col("a")).alias("fingerprint"), packed(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), near_next.alias("near_next"))
