"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the linking radius. Two fingerprints that
share a variant are within the radius by the triangle inequality, and two within the radius
share at least one variant, so the members of a variant form a clique: a star to its least
member keeps every link's connectivity without writing out pairs.

A lossless screen goes first. Cut the 64 bits in three blocks; of two fingerprints at most
four bits apart, one block holds two of the differences (or all, if fewer), so the rest agrees up to two
bits and again meets half-way, at one flip. Fingerprints alone in all their 131 screen keys have
no partner and emit no ball. Its selectivity is about 3e-10 a pair. Colliding pairs are verified by their number of differing bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, components, discard, join_counted, materialize, text_bytes

RADIUS, SHINGLE, SEED = 4, 4, 42
ROWS_A_TASK = 1_000_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; 0 if it has no words."""
    words = data.lower().split()  # bytes: only A-Z are lowered, only the six ASCII blanks split
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip((end - size)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, dtype="<u8")
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        fp = pa.array([_signed(fingerprint(x)) for x in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per input row; a null text counts as empty."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", text_bytes()).mapInArrow(_fingerprints, schema)


def _array(masks: list[int]):
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _xor(base, masks: list[int]):
    return F.transform(_array(masks), lambda m: base.bitwiseXOR(m))


def _screen_keys(fp):
    """Keys of which fingerprints at most RADIUS bits apart share one: a block filled with ones, up to one other bit flipped."""
    cuts = [(0, 22), (22, 43), (43, 64)]
    keys = []
    for a, b in cuts:
        block = sum(1 << i for i in range(a, b))
        keys.append(_xor(fp.bitwiseOR(F.lit(_signed(block))), [0, *(1 << i for i in range(64) if not a <= i < b)]))
    return F.concat(*keys)


def _ball() -> list[int]:
    """Masks of at most RADIUS / 2 bits."""
    return [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]


def _clique_stars(keyed: DataFrame) -> DataFrame:
    """A written table (u, v): every fp of a shared key with the key's least fp. A key of two fps gives its edge at once; only keys of more are joined back."""
    shared = materialize(keyed.groupBy("k").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-shared")
    pairs = shared.where("n = 2").select(F.col("b").alias("u"), F.col("a").alias("v"))
    more = keyed.join(shared.where("n > 2").select("k", "a").hint("shuffle_hash"), "k").where("fp <> a")
    colliding = pairs.unionByName(more.select(F.col("fp").alias("u"), F.col("a").alias("v"))).distinct()
    out = materialize(colliding.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS), "simhash-links")
    discard(shared)
    return out


def _dealt(fps: DataFrame, fan_out: int) -> DataFrame:
    """fps over so many tasks that each writes about ROWS_A_TASK rows; Spark sizes tasks by the few bytes they read."""
    return fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() * fan_out // ROWS_A_TASK + 1))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose transitive closure is that of 'at most RADIUS bits apart'."""
    keyed = _dealt(fps, 131).select("fp", F.explode(_screen_keys(F.col("fp"))).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("k")
    near = materialize(keyed.join(shared.hint("shuffle_hash"), "k", "left_semi").select("fp").distinct(), "simhash-screen")
    out = _clique_stars(_dealt(near, 2081).select("fp", F.explode(_xor(F.col("fp"), _ball())).alias("k")))
    discard(near)
    return out


def rooted(fps: DataFrame) -> DataFrame:
    """A written table (fp, root) of the fingerprints with a link."""
    edges = links(fps)
    out = components(edges).withColumnRenamed("node", "fp")
    discard(edges)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text; further columns are ignored).

    Null and blank texts have fingerprint zero and link like any other. Repeated rows each get
    a row, in one component. A null doc_id never names a component unless it has no other
    member, when component_id is null. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs), "simhash")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    root = materialize(rooted(fps.select("fp")), "simhash-roots")
    named = materialize(root.join(fps, "fp").groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-named")
    of = join_counted(root, named, "root").select("fp", "component_id")
    names = materialize(fps.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "simhash-names")
    discard(fps, root, named)
    return join_counted(rows, names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs and __fp, written once."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            fp = pa.array([_signed(fingerprint(x or b"")) for x in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fp], [*b.schema.names, "__fp"])

    return materialize(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])), "simhash-rows")


#: Columns of its own that deduplicate() adds on the way; those of docs that bear such a name are set aside meanwhile.
OWN = ("__fp", "__n")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, whatever the ids: of the least doc_id; of rows with that id, of the least fingerprint, then the least by text, then by the other columns as JSON. Rows without doc_id are reduced to one a component by themselves, beside the one with an id.

    Null and blank texts have fingerprint zero and link like any other. Further columns stay as they are, whatever their names. An empty table gives no rows.
    """
    if clash := {c: f"__own_{c}" for c in docs.columns if c in OWN}:
        return deduplicate(docs.withColumnsRenamed(clash)).withColumnsRenamed({v: k for k, v in clash.items()})
    rows = _with_fingerprint(docs)
    seen = materialize(rows.groupBy(F.col("__fp").alias("fp"), F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "simhash-ids")
    fps = materialize(seen.select("fp").distinct(), "simhash-distinct")
    both = seen.join(rooted(fps), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    discard(fps)
    kept = both.groupBy("root", F.col("id").isNull()).agg(F.min(F.struct("id", "fp", "n")).alias("k")).select("k.fp", "k.id", "k.n")
    kept = materialize(kept, "simhash-kept")
    same = lambda t: (F.col("__fp") == t["fp"]) & F.col("doc_id").eqNullSafe(t["id"])
    lost = seen.join(kept.where("n = 1").select(F.col("fp").alias("f"), F.col("id").alias("i")), (F.col("fp") == F.col("f")) & F.col("id").eqNullSafe(F.col("i")), "left_anti")
    alike = kept.where("n > 1")  # only these texts are sorted
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("__fp", "doc_id").orderBy("text", *([F.to_json(F.struct(*others))] if others else []))  # as JSON, maps can be ordered too
    first = rows.join(alike, same(alike), "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return rows.join(lost, same(lost), "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
