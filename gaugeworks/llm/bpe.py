"""Byte-level BPE by overlapping chunks: long texts are pre-tokenised in parallel, stitched where the pre-token borders of neighbours meet, then encoded."""

from __future__ import annotations

import base64
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, pieces

#: Code points of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: A pre-token that ends this near a chunk's end might be another one, had the chunk gone on: contractions take three characters.
MARGIN = 2
#: Distinct pre-tokens that a task remembers, and bytes of text that it works on at once.
MEMORY, SLICE = 100_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The file holds a line for each token: its bytes in base64 and its rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _vocabulary(path: str, pattern: str) -> dict:
    """What tasks need: ranks, pattern, and stand-ins for the characters that the two regular-expression libraries class differently.

    The encoder's library and regex follow different Unicode versions, so newly assigned letters and digits are
    told apart by one and not by the other. Both are asked about every code point once; such characters are replaced, one by one, by a
    character of the class that the encoder's library sees, before borders are looked for.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    kinds = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\t", r"[^\s\p{L}\p{N}]": "!"}
    bytewise = {bytes([i]): i for i in range(256)}
    stand_in = {}
    for kind, shown in kinds.items():
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=bytewise, special_tokens={})
        theirs = bytes(probe.encode_ordinary(every)).decode()
        stand_in |= {ord(c): shown for c in set(theirs) - set(regex.findall(kind, every))}
    return {"ranks": read_ranks(path), "pattern": pattern, "stand_in": stand_in}


class _Encoder:
    """Splits texts and encodes pre-tokens; ids of distinct pre-tokens are remembered."""

    def __init__(self, vocab: dict):
        import tiktoken

        self.bpe = tiktoken.Encoding("ranks", pat_str=vocab["pattern"], mergeable_ranks=vocab["ranks"], special_tokens={})
        self.pattern, self.stand_in = regex.compile(vocab["pattern"]), vocab["stand_in"]
        self.odd = set(map(chr, self.stand_in))
        self.forget()

    def forget(self):
        self.number, self.at, self.flat = {}, array("q", [0]), array("i")

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if not text.isascii() and not self.odd.isdisjoint(text):
            found = self.pattern.findall(text.translate(self.stand_in))
            ends = np.cumsum([len(p) for p in found]).tolist()
            found = [text[a:b] for a, b in zip([0, *ends], ends)]
        else:
            found = self.pattern.findall(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern must leave out no character")
        return found

    def encode(self, split: list[list[str]]) -> pa.Array:
        """Lists of ids, of texts given by their pre-tokens."""
        flat = list(chain.from_iterable(split))
        if len(self.number) > MEMORY:
            self.forget()
        for p in set(flat).difference(self.number):
            self.number[p] = len(self.number)
            self.flat.extend(self.bpe.encode_ordinary(p))
            self.at.append(len(self.flat))
        known, at = np.array(self.flat, np.int32), np.array(self.at)
        rows = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        end = np.cumsum(at[rows + 1] - at[rows])
        size = np.diff(end, prepend=0)
        ids = known[np.repeat(at[rows] - end + size, size) + np.arange(size.sum())]
        border = np.append(0, end)[np.cumsum([0, *map(len, split)])]
        return pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(ids, pa.int32()))


def _seams(found: list[str], start: int, nxt: int, last: bool, overlap: int) -> tuple[list[int], list[int]]:
    """Borders of a chunk (absolute places) in its own head and in the head of the chunk after it, the latter only if more text could not move them."""
    ends = start + np.cumsum([0, *map(len, found)])
    head = ends[ends < start + overlap]
    tail = ends[(ends >= nxt) & (ends <= ends[-1] - MARGIN)] if not last else ends[:0]
    return head.tolist(), tail.tolist()


def _long(rows: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(row, ids) of written rows (row, text): texts of several chunks.

    Where a chunk and the one before share no border in the overlap, its start is given up and the one before reaches as far as the next start; such
    texts are cut and read again, until each start has its seam. Only texts with a stretch of overlap characters without a border need that.
    """

    def cut(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                out = []
                for row, text, starts in zip(*(c.to_pylist() for c in b.columns)):
                    for k, s in enumerate(starts):
                        nxt = starts[k + 1] if k + 1 < len(starts) else None
                        out.append((row, s, nxt, text[s : None if nxt is None else nxt + overlap]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["row", "start", "nxt", "body"])

    def pre_tokenise(batches):
        encoder = _Encoder(shared.value)
        for batch in batches:
            heads, tails, sizes = [], [], []
            for start, nxt, body in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                found = encoder.split(body)
                head, tail = _seams(found, start, -1 if nxt is None else nxt, nxt is None, overlap)
                heads.append(head)
                tails.append(tail)
                sizes.append([len(p) for p in found])
            long, lists = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, lists), pa.array(heads, long), pa.array(tails, long)], ["row", "start", "nxt", "body", "sizes", "head", "tail"])

    def encode(batches):
        encoder = _Encoder(shared.value)
        for batch in batches:
            for b in pieces(batch, 2, SLICE):
                split = []
                for start, body, sizes, begin, end in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                    ends = np.cumsum([0, *sizes])
                    at = ends[slice(*np.searchsorted(ends, [begin - start, ends[-1] if end is None else end - start]) + [0, 1])].tolist()
                    split.append([body[a:z] for a, z in zip(at, at[1:])])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), encoder.encode(split)], ["row", "start", "ids"])

    starts = rows.select("row", F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk)).cast("array<bigint>").alias("starts"))
    pending, done = materialize(starts, "bpe-starts"), []
    while not pending.isEmpty():
        bodies = rows.join(pending, "row").select("row", "text", "starts").mapInArrow(cut, "row long, start long, nxt long, body string")
        parts = materialize(bodies.repartition("row", "start").mapInArrow(pre_tokenise, "row long, start long, nxt long, body string, sizes array<int>, head array<bigint>, tail array<bigint>"), "bpe-parts")
        order = Window.partitionBy("row").orderBy("start")
        begin = F.when(F.col("start") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), "head")))
        seams = parts.select("row", "start", begin.alias("begin"))
        seams = seams.select("row", "start", "begin", F.lead("begin").over(order).alias("end"), F.every(F.col("begin").isNotNull()).over(Window.partitionBy("row")).alias("whole"))
        seams = materialize(seams, "bpe-seams")
        met = seams.where("whole").select("row", "start", "begin", "end")
        done.append(materialize(parts.join(met, ["row", "start"]).select("row", "start", "body", "sizes", "begin", "end").mapInArrow(encode, "row long, start long, ids array<int>"), "bpe-ids"))
        again = materialize(seams.where("NOT whole AND begin IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_list("start")).alias("starts")), "bpe-starts")
        discard(pending, parts, seams)
        pending = again
    discard(pending)
    if not done:
        return rows.select("row", F.array().cast("array<int>").alias("ids"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the BPE ids of every row's whole text, each pre-token by itself, without special tokens (their strings are ordinary text).

    Texts up to a chunk are encoded where they lie; longer ones are cut, and their chunks dealt over all tasks. A null or empty text has no ids.
    Repeated rows and rows without doc_id are encoded each for itself; other columns are not read. An empty table gives no rows. The pattern must
    match every character, look ahead by one at most, and not behind. A pre-token that is longer than a chunk stays with one task.
    """
    if not MARGIN < overlap <= chunk:
        raise ValueError("overlap must be over MARGIN and at most chunk")
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(_vocabulary(ranks_path, pattern))  # a fixed vocabulary

    def whole(batches):
        encoder = _Encoder(shared.value)
        for batch in batches:
            for b in pieces(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0), encoder.encode([encoder.split(t or "") for t in b.column(1).to_pylist()])], ["doc_id", "ids"])

    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = docs.where(~is_long).select("doc_id", "text").mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    rows = materialize(docs.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "bpe-long")
    ids = materialize(_long(rows.select("row", "text"), shared, chunk, overlap), "bpe-joined")
    return short.unionByName(rows.select("row", "doc_id").join(ids, "row").select("doc_id", "ids"))


def decode(encoded: DataFrame, ranks_path: str, to: str = "data") -> DataFrame:
    """encoded (ids array<int>, ...) with a binary column named by to: the tokens' raw bytes in a row, which need not be whole UTF-8. It takes the place of a column of that name.

    Null ids give null, no ids an empty value; a null among the ids or one that no token has is an error. An empty table gives no rows.
    """
    bounded_batches(encoded.sparkSession)
    ranks = read_ranks(ranks_path)
    tokens = dict(zip(ranks.values(), ranks))
    shared = encoded.sparkSession.sparkContext.broadcast({"tokens": [tokens.get(i) for i in range(max(tokens, default=-1) + 1)]})

    @F.arrow_udf("binary")
    def joined(ids: pa.Array) -> pa.Array:
        if "raw" not in shared.value:
            shared.value["raw"] = pa.array(shared.value.pop("tokens"), pa.large_binary())
        raw = shared.value["raw"]
        flat = ids.flatten()
        known = not len(flat) or 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(raw)
        taken = raw.take(flat) if known else None
        if taken is None or taken.null_count:
            raise ValueError("an id stands for no token")
        sizes = pc.list_value_length(ids)
        at = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy())])
        out = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), taken), pa.scalar(b"", pa.large_binary()))
        return pc.if_else(pc.is_valid(ids), out, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    return encoded.withColumn(to, joined("ids"))
