"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame functions only. Every source is cut into blocks of documents by hash. A source's
target is met by whole rounds over all its blocks plus blocks in a permuted order up to the
target; in the last few blocks single documents are chosen by hash thresholds, so the
choice can be made row by row. The block draws of all sources are then dealt to output
shards: at each node of a binary tree over the shards a half of the draws, chosen by least hash, goes
left, which splits the sources' exact quotas by the multivariate hypergeometric law; every
shard takes the next run of each source's permuted blocks, a document is taken once by each draw of its block, and rows are shuffled inside a shard.
All randomness is hashes of the seed and the keys, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, small_side

WEIGHTS, MAX_REPEATS, SHARDS, SEED = (1, 2, 3), 3, 8, 7
BLOCKS, DOCS_A_BLOCK, REGION_DOCS, BACK, PASSES, VARIANTS = 256, 4, 512, 64, 4, 16
SOURCES_BROADCAST, PLAN_BROADCAST, ROWS_A_PART = 50_000, 50_000, 20_000
#: Bits of a hash that tell ranges of draws apart.
HASH_RANGES = 16


ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_shards"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, s, source_size, n_docs, target) from (source, size) rows, a written table; s numbers the sources by code point, null last, from 1.

    Weights repeat in that order. With caps max_repeats * size and one level L for all, targets are least(cap, L * weight). L is sought from below: sources whose cap is under
    the level are set to it and what is left is shared again, until none is; the set only grows, and each step is one sum over the sources. Numbers come
    from ranges of sources laid out over tasks, so no task meets them all.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = [F.col("source").isNull(), F.col("source")]
    laid = materialize(src.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("at", 33)  # the partition's number; below it stands the row's place
    ranges = laid.groupBy(part.alias("part")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    src = laid.withColumn("part", part).join(ranges.select("part", (before - F.col("low")).alias("shift")), "part").withColumn("s", F.col("at") + F.col("shift") + 1).drop("part", "at", "shift")
    cap = F.col("source_size") * float(max_repeats)
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int")))
    src = materialize(src.withColumn("cap", cap), "mix-sources-sized")
    discard(laid)
    total, free, level, last = src.agg(F.sum("source_size"), F.sum("w")).first() + (None, None)
    level = total / free if free else 0.0
    while level != last:
        low = F.col("cap") < F.lit(level) * F.col("w")
        capped, free = src.agg(F.coalesce(F.sum(F.when(low, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~low, F.col("w")))).first()
        last, level = level, (total - capped) / free if free else level
    return src.select("source", "s", "source_size", "n_docs", F.least("cap", F.lit(max(level, 0.0)) * F.col("w")).alias("target"))


def _uniform(*keys) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def split_quotas(quotas: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(s, cuts): for (s, q) rows, one an s, the cumulative numbers of the q draws that go to shards 0, 1, ...; n_shards is a power of two.

    At each node every draw has a hash, and the half with the least go left: which draws these are is uniform over all halves, so how many
    are of each source follows the multivariate hypergeometric law. Where the middle lies is found by counts of HASH_RANGES ranges of hashes; only the draws of the range with the middle are
    ranked. No node gathers its sources or its draws.
    """
    draws = quotas.where("q > 0").select("s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("q"))).alias("i"), F.lit(1).cast("long").alias("node"))
    for _ in range(n_shards.bit_length() - 1):
        u = F.xxhash64(F.lit(seed), "node", "s", "i")
        draws = materialize(draws.select("s", "i", "node", u.alias("u"), F.shiftrightunsigned(u, 64 - HASH_RANGES).alias("r")), "mix-draws")
        upto = F.sum("n").over(Window.partitionBy("node").orderBy("r"))
        counts = draws.groupBy("node", "r").agg(F.count(F.lit(1)).alias("n")).withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy("node"))})
        half = (F.col("total") / 2 + F.when(_uniform(F.lit(seed), F.lit("odd"), F.col("node")) < 0.5, 0.5).otherwise(0.0)).cast("long")
        middle = counts.withColumn("half", half).where("upto - n < half AND half <= upto").select("node", F.col("r").alias("at"), (F.col("half") - F.col("upto") + F.col("n")).alias("need"))
        middle = F.broadcast(materialize(middle, "mix-middle"))  # at most a row a node, fewer than n_shards
        placed = draws.join(middle, "node", "left")
        ranked = F.row_number().over(Window.partitionBy("node").orderBy("u", "s", "i"))
        near = placed.where("r = at").withColumn("left", ranked <= F.col("need"))
        far = placed.where("at IS NULL OR r <> at").withColumn("left", F.coalesce(F.col("r") < F.col("at"), F.lit(False)))
        draws = near.unionByName(far).select("s", "i", F.when(F.col("left"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1).alias("node"))
    each = draws.groupBy("s").agg(*[F.count_if(F.col("node") <= n_shards + k).alias(f"c{k}") for k in range(n_shards)])
    none = quotas.where("q <= 0").select("s", F.array(*[F.lit(0).cast("long")] * n_shards).alias("cuts"))
    return each.select("s", F.array(*[f"c{k}" for k in range(n_shards)]).alias("cuts")).unionByName(none)


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("document"), F.col("doc_id"))


def _block(blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col("doc_id")), blocks)


def plan(narrow: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, n_shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): what the mix takes of every block. narrow is a written table (doc_id, source, size)."""
    per_source = targets(narrow, weights, max_repeats).withColumns({"n_blocks": F.greatest(F.lit(1), F.least(F.greatest(F.lit(BLOCKS), F.floor(F.sqrt("n_docs"))), F.expr(f"n_docs div {DOCS_A_BLOCK}"))), "rounds": F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(max_repeats), F.floor(F.col("target") / F.col("source_size"))))})
    sources = materialize(per_source.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("rounds") * F.col("source_size"))), "mix-sources")
    keyed = _keyed(narrow, sources, seed)
    permuted = Window.partitionBy("s").orderBy("key", "block")
    blocks = keyed.groupBy("s", "block", "rounds", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).withColumn("key", F.xxhash64(F.lit(seed), F.lit("permute"), "s", "block"))
    blocks = blocks.withColumns({"upto": F.sum("words").over(permuted), "docs_upto": F.sum("docs").over(permuted)})
    # Where whole rounds meet the target, nothing is drawn beyond them, no empty text either. The last BACK documents that fit join the region.
    fits = (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)
    blocks = blocks.withColumn("fit", F.max(F.when(fits, F.col("docs_upto"))).over(Window.partitionBy("s")))
    full = fits & (F.col("docs_upto") <= F.col("fit") - BACK)
    blocks = blocks.withColumns({"full": full, "docs_full": F.coalesce(F.max(F.when(full, F.col("docs_upto"))).over(Window.partitionBy("s")), F.lit(0)), "words_full": F.coalesce(F.max(F.when(full, F.col("upto"))).over(Window.partitionBy("s")), F.lit(0))})
    blocks = materialize(blocks.withColumn("region", ~F.col("full") & (F.col("rest") > F.col("words_full")) & (F.col("docs_upto") - F.col("docs") < F.col("docs_full") + REGION_DOCS)), "mix-blocks")
    # Single documents of each source's region: by rising hash as long as they fit, then again among the smaller ones left; at last the
    # one that comes nearest to what is missing, if that helps. Of VARIANTS hash orders the one that ends nearest to the target is kept.
    side = small_side(blocks.where("region").select("s", "block", (F.col("rest") - F.col("words_full")).alias("e0")), PLAN_BROADCAST)
    region = keyed.select("s", "block", "size", "hash").join(side, ["s", "block"])
    variants = F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v")
    left = materialize(region.select("s", variants, "hash", "size", "e0").withColumn("hash", F.xxhash64("hash", "v")), "mix-region")
    chosen, before_pass = None, left
    for k in range(PASSES):
        room = left.where(F.col("size") <= F.col(f"e{k}")).groupBy("s", "v", "hash", f"e{k}").agg(F.sum("size").alias("size"))
        room = room.withColumn("upto", F.sum("size").over(Window.partitionBy("s", "v").orderBy("hash"))).where(F.col("upto") <= F.col(f"e{k}"))
        got = materialize(room.groupBy("s", "v").agg(F.max("hash").alias(f"t{k}"), F.sum("size").alias("got")), "mix-got")
        left = left.join(got, ["s", "v"], "left").withColumn(f"e{k + 1}", F.col(f"e{k}") - F.coalesce("got", F.lit(0))).drop("got")
        rest = materialize(left.where(F.col(f"t{k}").isNull() | (F.col("hash") > F.col(f"t{k}")) | (F.col("size") > F.col(f"e{k}"))).drop(f"t{k}"), "mix-left")
        discard(before_pass)
        left = before_pass = rest
        got = got.drop("got")
        chosen = got if chosen is None else chosen.join(got, ["s", "v"], "full")
    rooms = left.groupBy("s", "v").agg(*[F.first(f"e{k}").alias(f"e{k}") for k in range(1, PASSES + 1)])
    last = left.groupBy("s", "v", "hash", f"e{PASSES}").agg(F.sum("size").alias("size")).withColumn("off", F.abs(F.col(f"e{PASSES}") - F.col("size"))).where(F.col("off") < F.col(f"e{PASSES}"))
    last = last.groupBy("s", "v").agg(F.min(F.struct("off", "hash")).alias("near"))
    ways = rooms.join(last, ["s", "v"], "left").join(chosen, ["s", "v"], "left")
    ways = ways.select("s", "v", *[f"e{k}" for k in range(1, PASSES)], *[f"t{k}" for k in range(PASSES)], F.col("near.hash").alias("last"), F.coalesce("near.off", f"e{PASSES}").alias("miss"))
    # written, as are the cuts: the driver plans a few short queries, not one of all passes and levels
    marks = materialize(ways.groupBy("s").agg(F.min_by(F.struct(*[c for c in ways.columns if c not in ("s", "miss")]), F.struct("miss", "v")).alias("w")).select("s", "w.*"), "mix-marks")
    draws = blocks.select("s", "block", "key", F.explode(F.expr("if(rounds + cast(full OR region AS int) > 0, sequence(1, cast(rounds + cast(full OR region AS int) AS int)), cast(array() AS array<int>))")).alias("copy"))
    quotas = materialize(draws.groupBy("s").agg(F.count(F.lit(1)).alias("q")), "mix-quotas")
    cuts = materialize(split_quotas(quotas, n_shards, seed), "mix-cuts")
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), F.lit("draw"), "key", "copy"), "block", "copy")
    dealt = draws.withColumn("at", F.row_number().over(order)).join(cuts, "s").withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("at"))))
    shards = dealt.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    out = blocks.select("s", "block", "full", "region", (F.col("rest") - F.col("words_full")).alias("e0")).join(shards, ["s", "block"], "left").join(marks, "s", "left")
    return sources, materialize(out, "mix-plan")


def _keyed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    side = small_side(sources, SOURCES_BROADCAST).select(F.col("source").alias("__source"), "s", "source_size", "target", "n_blocks", "rounds", "rest")
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return joined.withColumns({"block": _block(F.col("n_blocks"), seed), "hash": _hash(seed)})


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs plus mix_size, mix_source_size, mix_target, mix_copies and mix_shards (the shard of each copy).

    Sizes are words; a null text has none. Null sources are one source, the last. Rows with the
    same doc_id (or none) are chosen together; repeated rows each count. Columns of docs that bear the added names are
    replaced. An empty table gives no rows; if all texts are empty, targets are 0 and nothing is drawn.
    """
    docs = docs.drop(*ADDED)
    sized = docs.withColumn("mix_size", n_words(F.col("text")))
    narrow = materialize(sized.select("doc_id", "source", F.col("mix_size").alias("size")), "mix-sizes")
    sources, blocks = plan(narrow, weights, max_repeats, n_shards, seed)
    return _apply(docs.columns, sized, sources, blocks, seed)


def sizes_mixed(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """As mix(), but with doc_id and the added columns only; texts are read once."""
    narrow = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources, blocks = plan(narrow, weights, max_repeats, n_shards, seed)
    return _apply(["doc_id"], narrow.withColumnRenamed("size", "mix_size"), sources, blocks, seed)


def _apply(columns: list[str], rows: DataFrame, sources: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    slim = rows.select(*dict.fromkeys([*columns, "doc_id", "source", "mix_size"]))
    side = small_side(sources, SOURCES_BROADCAST).select(*[F.col(c).alias(f"__{c}") for c in ("source", "s", "source_size", "target", "n_blocks", "rounds")])
    d = slim.join(side, F.col("source").eqNullSafe(F.col("__source"))).withColumns({"__block": _block(F.col("__n_blocks"), seed), "__hash": _hash(seed)})
    b = small_side(blocks, PLAN_BROADCAST).select(*[F.col(c).alias(f"__b_{c}") for c in blocks.columns])
    d = d.join(b, (F.col("__s") == F.col("__b_s")) & (F.col("__block") == F.col("__b_block")))
    own = F.xxhash64("__hash", "__b_v")
    fits = [F.coalesce((own <= F.col(f"__b_t{k}")) & (F.col("mix_size") <= F.col(f"__b_e{k}")), F.lit(False)) for k in range(PASSES)]
    fits.append(F.coalesce(own == F.col("__b_last"), F.lit(False)))
    extra = F.col("__b_full") | (F.col("__b_region") & reduce(lambda a, b: a | b, fits))
    # a document is taken by every shard that drew its block, in a block's last draw only if it is among those that fit
    mine = F.filter(F.coalesce("__b_draws", F.expr("cast(array() AS array<struct<copy:int,shard:int>>)")), lambda x: (x["copy"] <= F.col("__rounds")) | extra)
    out = d.withColumn("mix_shards", F.transform(mine, lambda x: x["shard"])).withColumn("mix_copies", F.size("mix_shards"))
    return out.select(*[F.col(f"`{c}`") for c in columns], "mix_size", F.col("__source_size").alias("mix_source_size"), F.col("__target").alias("mix_target"), "mix_copies", "mix_shards")


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, a row a copy, with the columns of docs, shuffled by hash inside each shard. Documents of which no copy is drawn go.

    Part p of the result is shard p; of more than ROWS_A_PART documents a shard, each shard is a run of equally many parts, by rising hash.
    """
    seed, n_shards = options.get("seed", SEED), options.get("n_shards", SHARDS)
    m = -(-max(docs.count(), 1) // (n_shards * ROWS_A_PART))
    own = {c: f"__own_{c}" for c in docs.columns if c in ADDED}
    rows = mix(docs.withColumnsRenamed(own), **options).select("*", F.posexplode("mix_shards").alias("__copy", "__shard"))
    rows = rows.withColumn("__at", F.xxhash64(F.lit(seed), "__shard", "doc_id", "__copy"))
    slot = F.least(F.floor((F.col("__at") / float(1 << 64) + 0.5) * m), F.lit(m - 1))
    parts = rows.withColumn("__part", (F.col("__shard") * m + slot).cast("int")).repartitionById(n_shards * m, "__part")
    return parts.sortWithinPartitions("__part", "__at").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
