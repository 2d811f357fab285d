"""Corpus operators: n-gram tables, document frequency, contamination joins, cleaning, statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import kth
from ..functions.text import let, ngrams, normalize, words
from ..sources.scratch import removed, written


#: Distinct 64-bit n-gram hashes that may be broadcast as they are (some 100 bytes each while the driver builds their table); beyond, a filter of their bits is.
BROADCAST_GRAMS = 500_000
#: A filter has blocks of 32 words of 64 bits; BITS for each hash, of which PROBES are set, give about 0.5 % false positives. It may grow to MAX_FILTER bytes (22 million hashes), since the driver builds and sends
#: it at some five times its size; beyond, hashes that no document has are taken out first, by a filter of COARSE_PROBES that passes more, and if still too many are left, the share of false positives grows instead.
BLOCK_WORDS, BITS, PROBES, COARSE_PROBES, MAX_FILTER = 32, 12, 5, 2, 32 << 20


def ngram_table(docs: DataFrame, key: str, n: int, text: str = "text", normal=normalize) -> DataFrame:
    """(key, ngram): distinct word n-grams of the normalised text."""
    return docs.select(key, F.explode(F.array_distinct(ngrams(words(normal(F.col(text))), n))).alias("ngram"))


def gram_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit hash of each run of n tokens."""

    def of(h):
        many = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, many).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def _placed(docs: DataFrame, key: str, n: int, text: str = "text", normal=normalize) -> DataFrame:
    """(key, w, i, h): the words of a document and the place and hash of each of its n-grams."""
    return docs.select(key, words(normal(F.col(text))).alias("w")).select(key, "w", F.posexplode(gram_hashes(F.col("w"), n)).alias("i", "h"))


def _hashes(docs: DataFrame, n: int, normal=normalize) -> DataFrame:
    return docs.select(F.explode(gram_hashes(words(normal(F.col("text"))), n)).alias("h"))


def _probes(h: Column, probes: int = PROBES) -> list[tuple[Column, Column]]:
    """The (word, mask) pairs that a hash sets in its block: eleven bits of a second hash each."""
    other = F.xxhash64(h)
    bits = [F.shiftright(other, 11 * k).bitwiseAND(F.lit(BLOCK_WORDS * 64 - 1).cast("long")).cast("int") for k in range(probes)]
    return [(F.shiftright(b, 6), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))) for b in bits]


def _block(blocks: int) -> Column:
    return F.pmod("h", F.lit(blocks).cast("long"))


def gram_filter(hashes: DataFrame, about: int, probes: int = PROBES) -> tuple[DataFrame, int]:
    """A Bloom filter of the hashes (h), of which about many are distinct: (block, bits) rows, written, and the number of blocks.

    Bits are joined by or, within tasks first, so what is shuffled is bounded by tasks times the filter, whatever the number of hashes.
    """
    size = BLOCK_WORDS * 64
    blocks = max(1, min(-(-about * BITS // size), MAX_FILTER // (size // 8)))
    each = hashes.select(_block(blocks).alias("block"), F.inline(F.array(*[F.struct(w.alias("word"), m.alias("mask")) for w, m in _probes(F.col("h"), probes)])))
    joined = each.groupBy("block", "word").agg(F.bit_or("mask").alias("mask")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return written(joined.select("block", bits.alias("bits")), "gram-filter"), blocks


def may_hold(rows: DataFrame, bits: DataFrame, blocks: int, probes: int = PROBES) -> DataFrame:
    """The rows (h, ...) whose hash may be in the filter: all that are, and few others. The filter is broadcast; rows stream by, unshuffled."""
    tests = [F.get("bits", w).bitwiseAND(m) != 0 for w, m in _probes(F.col("h"), probes)]
    met = rows.withColumn("block", _block(blocks)).join(F.broadcast(bits), "block")
    for t in tests:
        met = met.where(t)
    return met.drop("block", "bits")


def _surviving(docs: DataFrame, key: str, n: int, hashes: DataFrame, about: int, broadcast_grams: int | None = None, normal=normalize, own: bool = False) -> DataFrame:
    """(key, ngram), distinct and written: the n-grams of docs whose hash is, or for more than broadcast_grams may be, among hashes (h), of which about many are distinct. docs stream by; only what is left is shuffled. own: docs have all of the hashes."""
    side, blocks = gram_side(hashes, about, broadcast_grams, None if own else _hashes(docs, n, normal))
    out = written(met_grams(docs, key, n, side, blocks, normal=normal), "gram-survivors")
    removed(side)
    return out


def gram_side(hashes: DataFrame, about: int, broadcast_grams: int | None = None, against: DataFrame | None = None) -> tuple[DataFrame, int | None]:
    """What documents meet as they stream by, written: the distinct hashes (h) and None, or beyond broadcast_grams a filter of their bits and its number of blocks.

    Where a filter of MAX_FILTER bytes would pass too many, hashes that are not in against, those of the documents (h), are left out: the documents' stream by the filter, and what it passes
    is shuffled and joined with hashes, eight bytes a row. So what goes through the driver is bounded whatever the number of hashes.
    """
    if about <= (BROADCAST_GRAMS if broadcast_grams is None else broadcast_grams):
        return written(hashes.distinct(), "gram-hashes"), None
    if against is None or about * BITS <= MAX_FILTER * 8:
        return gram_filter(hashes, about)
    coarse, blocks = gram_filter(hashes, about, COARSE_PROBES)
    # Spark would size the hashes by the few bytes of their texts, and broadcast them
    met = written(hashes.join(may_hold(against, coarse, blocks, COARSE_PROBES).hint("merge"), "h", "left_semi").distinct(), "gram-met")
    side = gram_side(met, met.count(), broadcast_grams)
    removed(coarse, met)
    return side


def asked_side(asked: DataFrame, docs: DataFrame, n: int, normal=normalize) -> tuple[DataFrame, int | None]:
    """The gram_side() of the n-grams of asked, for docs to stream by."""
    hashes, about = counted_hashes(asked, n, normal)
    return gram_side(hashes, about, against=_hashes(docs, n, normal))


def met_grams(docs: DataFrame, key: str, n: int, side: DataFrame, blocks: int | None, text: str = "text", normal=normalize) -> DataFrame:
    """(key, ngram), distinct: the n-grams of docs that a gram_side() holds, or may hold."""
    rows = _placed(docs, key, n, text, normal)
    left = rows.join(F.broadcast(side), "h", "left_semi") if blocks is None else may_hold(rows, side, blocks)
    return left.select(key, F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.lit(n))).alias("ngram")).distinct()


def _about(hashes: DataFrame) -> int:
    """Distinct hashes, within some two hundredths."""
    return hashes.agg(F.approx_count_distinct("h", 0.02)).first()[0]


def counted_hashes(docs: DataFrame, n: int, normal=normalize) -> tuple[DataFrame, int]:
    """Hashes (h) of the n-grams of docs, and about how many of them are distinct."""
    hashes = _hashes(docs, n, normal)
    return hashes, _about(hashes)


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shared_grams(a: DataFrame, b: DataFrame, n: int, a_key: str, b_key: str, broadcast_grams: int | None = None, normal=normalize) -> tuple[DataFrame, DataFrame]:
    """((a_key, ngram), (b_key, ngram)), distinct and written: the n-grams of either side that the other may hold too.

    The hashes of the side of fewer bytes meet the other side as it streams by, and what is left of it meets the first. So either table has every n-gram that both
    sides have; what else is in it is a share of false positives, which the join of the two by n-gram takes out. Neither side is shuffled whole. normal is the form that texts are compared in.
    """
    if _text_bytes(a) > _text_bytes(b):
        large, small = shared_grams(b, a, n, b_key, a_key, broadcast_grams, normal)
        return small, large
    hashes = _hashes(a, n, normal)
    of_b = _surviving(b, b_key, n, hashes, _about(hashes), broadcast_grams, normal)
    back = of_b.select(text_hash(n).alias("h"))
    return _surviving(a, a_key, n, back, _about(back), broadcast_grams, normal), of_b


def text_hash(n: int) -> Column:
    """The hash of an n-gram from its text; none of its words holds a blank."""
    return F.get(gram_hashes(F.split("ngram", " "), n), F.lit(0))


def document_frequency(docs: DataFrame, n: int, more_than: int = 10, key: str = "doc_id", normal=normalize) -> DataFrame:
    """(ngram, docs): n-grams of more than more_than documents. Hashes are counted first; only the frequent ones are written out, and counted again by their text."""
    frequent = frequent_hashes(docs, n, more_than, normal=normal)
    left = _surviving(docs, key, n, frequent, frequent.count(), normal=normal, own=True)
    removed(frequent)
    return left.groupBy("ngram").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > more_than)


def frequent_hashes(docs: DataFrame, n: int, more_than: int, text: str = "text", normal=normalize) -> DataFrame:
    """(h), written: hashes of n-grams that more than more_than documents have; only hashes are shuffled."""
    each = docs.select(F.explode(F.array_distinct(gram_hashes(words(normal(F.col(text))), n))).alias("h"))
    return written(each.groupBy("h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > more_than).select("h"), "gram-frequent")


def contaminated(evaluation: DataFrame, training: DataFrame, n: int, eval_key: str, train_key: str, normal=normalize) -> DataFrame:
    """Keys of evaluation rows that share an n-gram with training."""
    own, other = shared_grams(evaluation, training, n, eval_key, train_key, normal=normal)
    return own.join(other.select("ngram").distinct(), "ngram", "left_semi").select(eval_key).distinct()


def match_statistics(evaluation: DataFrame, training: DataFrame, n: int, eval_key: str, train_key: str, normal=normalize) -> DataFrame:
    """One row: total, unique, matching and non-matching evaluation n-grams. Training n-grams stream by as hashes."""
    grams = evaluation.select(F.explode(ngrams(words(normal(F.col("text"))), n)).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    own, other = shared_grams(evaluation, training, n, eval_key, train_key, normal=normal)
    both = own.select("ngram").join(other.select("ngram"), "ngram", "left_semi").distinct()
    rows = grams.select("n", F.lit(1).alias("one"), F.lit(0).alias("hit")).unionByName(both.select(F.lit(0).cast("long").alias("n"), F.lit(0).alias("one"), F.lit(1).alias("hit")))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(whole("n").alias("total"), whole("one").alias("unique"), whole("hit").alias("matching"), (whole("one") - whole("hit")).alias("non_matching"))


#: Words whose counts may be broadcast (some 40 bytes each in a hash table); the others, none of which is frequent, are joined.
HEAD_WORDS = 1_000_000


def unigram_scores(docs: DataFrame, key: str, smoothing: float = 1.0, text: str = "text") -> DataFrame:
    """(key, v, w): each document's log-likelihood under smoothed counts of all words, and its words. A document without words gives no row.

    Words are counted, and compared, as 64-bit hashes. Where all or the most frequent are broadcast, documents stream by twice and only a row a document and task is shuffled.
    """
    each = docs.select(key, F.explode(words(F.col(text))).alias("t")).select(key, F.xxhash64("t").alias("h"))
    counts = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "unigram-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    scored = counts.select("h", "n", F.log((F.col("n") + smoothing) / (total + smoothing * distinct or 1)).alias("p"))
    if distinct <= HEAD_WORDS:
        met = each.join(F.broadcast(scored.drop("n")), "h")
    else:
        cut = -kth(counts.select((-F.col("n")).alias("m")), [], "m", F.lit(HEAD_WORDS - 1), ["m"]).first()[0]
        head = F.broadcast(scored.where(F.col("n") > cut).drop("n"))
        met = each.join(head, "h").unionByName(each.join(head.select("h"), "h", "left_anti").join(scored.where(F.col("n") <= cut).drop("n"), "h"))
    return met.groupBy(key).agg(F.sum("p").alias("v"), F.count(F.lit(1)).alias("w"))


def spans(docs: DataFrame, key: str, n: int, normal=normalize) -> DataFrame:
    """(key, ngram, start, stop): n-grams of the raw words, normalised afterwards, with the first and last character's place."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf["text"]):
                found = [(m.group(), m.start(), m.end() - 1) for m in re.finditer(r"\S+", text or "")]
                rows += [(k, " ".join(w for w, _, _ in found[i : i + n]), found[i][1], found[i + n - 1][2]) for i in range(len(found) - n + 1)]
            yield pd.DataFrame(rows, columns=[key, "ngram", "start", "stop"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, ngram string, start long, stop long").withColumn("ngram", normal(F.col("ngram")))


def cut_out(text: str, hits: list[tuple[int, int]], window: int = 200, cutoff: int = 10, least: int = 200) -> list[str]:
    """Slices of text left after each hit and window characters about it go; none if there are more than cutoff hits.

    Slices must be longer than least. Each hit moves the cut to its own end, even backwards; the last slice begins one after it.
    """
    if len(hits) > cutoff:
        return []
    kept, at, stop = [], 0, -1
    for start, last in hits:
        begin, stop = max(0, start - window), min(len(text), last + window)
        if begin - at > least:
            kept.append(text[at:begin])
        at = stop
    if stop < len(text) - least:
        kept.append(text[stop + 1 :])
    return kept


def clean(docs: DataFrame, contaminants: DataFrame, n: int, key: str = "doc_id", window: int = 200, cutoff: int = 10, least: int = 200, normal=normalize) -> DataFrame:
    """(key, chunks): the clean slices of each document. Only documents that share an n-gram with the contaminants go through Python; the others are one slice, or none if they are short."""
    other = contaminants.columns[0]
    dirty = written(contaminated(docs, contaminants, n, key, other, normal), "gram-dirty")
    dirt = contaminants.select(F.explode(ngrams(words(normal(F.col("text"))), n)).alias("ngram")).distinct()
    suspects = docs.select(key, "text").join(dirty, key, "left_semi")
    hits = spans(suspects, key, n, normal).join(dirt, "ngram", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("hits"))

    @F.pandas_udf("array<string>")
    def slices(text, hits):
        import pandas as pd

        return pd.Series([cut_out(t or "", [(h["start"], h["stop"]) for h in (x if x is not None else [])], window, cutoff, least) for t, x in zip(text, hits)])

    cut = suspects.join(hits, key, "left").select(key, slices("text", "hits").alias("chunks"))
    whole = F.when(F.length("text") >= least, F.array("text")).otherwise(F.array().cast("array<string>"))
    return cut.unionByName(docs.join(dirty, key, "left_anti").select(key, whole.alias("chunks")))


def clean_dirty_split(scores: DataFrame, dirty: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(dirty, n, value): the mean score of the rows whose key is among dirty, and of the others."""
    marked = scores.join(dirty.select(key).distinct().withColumn("dirty", F.lit(True)), key, "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    return marked.groupBy("dirty").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("value"))


def gram_buckets(docs: DataFrame, key: str, n: int, path: str, buckets: int = 500) -> None:
    """Write (key, ngram) sorted within hash buckets, zstd-compressed: one folder a bucket."""
    rows = ngram_table(docs, key, n).withColumn("bucket", F.pmod(F.xxhash64("ngram"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "ngram", key).write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def statistics(docs: DataFrame, by: str) -> DataFrame:
    """(by, docs, characters, bytes, start): sizes of each part and the number of documents before it."""
    n = docs.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"))
    return n.withColumn("start", F.coalesce(F.sum("docs").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
