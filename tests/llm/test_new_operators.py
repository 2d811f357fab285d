"""Byte-level BPE, the Merkle manifest and periodic runs against the encoder's library, plain Python and brute force; and their queries on the whole smallest tables."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, merkle, periodic, pieces, queries, simhash
from gaugeworks.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, data int, runs int, row int, path string, root int, pos int, g map<string,int>"
EXTRA = ("x", 1, 1, 1, "p", 2, 3, {"k": 1})


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(table(spark, SF, "documents").collect(), key=lambda r: r.doc_id)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t):
    return (t or "").encode().split()


# ---- byte-level BPE
def mixed_texts():
    r = random.Random(5)
    parts = ["word", " it's", " they'll", "''s", "'s's's", "  ", "\n\n", " \n", "\t", "12345", " 42", "é", "Straße", "漢字仮名", "👩‍👩‍👧", "‍", "!!!", "...", " <|endoftext|>", "\x1c", "՘", "\U00013460", " ", "a" * 30, "-" * 40]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    return texts + ["x" * 3000, " " * 3000, "a b" * 1500, "'" * 700 + "s", "!" * 500 + "'ll" * 400, "ab" * 900 + " c" * 900 + "9" * 2000, "", " ", "\n", None]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (200, 8), (1000, 1000), (bpe.CHUNK, bpe.OVERLAP)])
def test_bpe_equals_the_library_whatever_the_chunks(spark, library, chunk, overlap):
    texts = mixed_texts()
    rows = [(i, t, None, None, 0, *EXTRA) for i, t in enumerate(texts)] + [(0, texts[0], None, None, 0, *EXTRA), (None, texts[1], None, None, 0, *EXTRA), (None, texts[1], None, None, 0, *EXTRA)]
    out = bpe.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), RANKS, public_tokenizers.PATTERN, chunk, overlap)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in out.collect())
    assert got == sorted((-1 if r[0] is None else r[0], library.encode_ordinary(r[1] or "")) for r in rows)
    back = bpe.decode(out.withColumn("data", F.lit(1)), RANKS).select("doc_id", "data").collect()
    assert Counter((r.doc_id, bytes(r.data)) for r in back) == Counter((r[0], (r[1] or "").encode()) for r in rows)


def test_bpe_edges(spark, library):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, library.encode_ordinary("é")[:1])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.data if r.data is None else bytes(r.data) for r in bpe.decode(ids, RANKS).collect()} == {1: None, 2: b"", 3: library.decode_single_token_bytes(library.encode_ordinary("é")[0])}
    assert bpe.decode(ids.limit(0), RANKS).count() == 0
    with pytest.raises(Exception, match="stands for no token"):
        bpe.decode(spark.createDataFrame([([50_256],)], "ids array<int>"), RANKS).collect()
    with pytest.raises(Exception, match="leave out no character"):
        bpe.encode(spark.createDataFrame([(1, "a 1")], "doc_id int, text string"), RANKS, r"\p{L}+").collect()


def test_op11(spark, docs, library):
    got = {r.doc_id: r for r in queries.queries()["op11_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(d.text or ""))


# ---- Merkle manifest
def tree(nodes):
    """(root, for each node its siblings level by level as (left, right))."""
    paths, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, of):
            run = at - at % 16
            path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        of = [at // 16 for at in of]
    return nodes[0], paths


def manifest(leaves):
    """(source, doc_id, leaf) to a list of (source, doc_id, leaf, path, subroot, root)."""
    by = defaultdict(list)
    for s, d, x in leaves:
        by[s].append((d is not None, d or 0, x, d))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    return [(s, x[3], x[2], path + tops[i], trees[s][0], root) for i, s in enumerate(order) for x, path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1])]


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 17, "Z": 16, "z": 257, "é": 2, "b": 15}, {"hot": 4500, "next": 4096, None: 4097}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_merkle_paths_equal_a_plain_tree(spark, sizes):
    leaves = [(s, i - 1 if i else None, sha(f"{s} {i}")) for s, n in sizes.items() for i in range(n)]
    leaves += leaves[:2]
    random.Random(1).shuffle(leaves)
    df = spark.createDataFrame([(*x, *EXTRA) for x in leaves], "source string, doc_id long, leaf string, ids string, data int, runs int, row int, path string, root int, pos int, g map<string,int>").repartition(5)
    got = merkle.prove(df).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("wrong", merkle.fold(F.lit("00"), F.col("path")))
    assert got.columns == ["source", "doc_id", "leaf", "ids", "data", "runs", "row", "g", "pos", "path", "subroot", "root", "folded", "wrong"]
    rows = got.collect()
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, *map(str, r[2:]))
    assert sorted(((r.source, r.doc_id, r.leaf, [tuple(x) for x in r.path], r.subroot, r.root) for r in rows), key=key) == sorted(manifest(leaves), key=key)
    assert all(r.folded == r.root != r.wrong and r.g == {"k": 1} for r in rows)


def test_merkle_edges(spark):
    assert merkle.prove(spark.createDataFrame([], "source string, doc_id long, leaf string")).count() == 0
    one = merkle.prove(spark.createDataFrame([(None, None, "ab")], "source string, doc_id long, leaf string")).collect()
    assert [(r.path, r.subroot, r.root, r.pos) for r in one] == [([], "ab", "ab", 0)]
    row = spark.createDataFrame([(None, "", "é:1")], "a long, b string, c string").select(merkle.leaf(F.col("a"), F.col("b"), F.col("c")).alias("x")).first()
    assert row.x == sha("-0:4:é:1")


def test_op12(spark, docs):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaf = lambda d, t: sha("".join(map(shown, (d.doc_id, d.source, d.lang, d.n_chars, t))))
    want = {d: (x, path, sub, root) for _, d, x, path, sub, root in manifest([(d.source, d.doc_id, leaf(d, d.text)) for d in docs])}
    got = {r.doc_id: r for r in queries.queries()["op12_merkle"](spark, SF).collect()}
    assert set(got) == set(want) and not all(r.verified for r in got.values()) and any(r.verified for r in got.values())
    for d in docs:
        x, path, sub, root = want[d.doc_id]
        at = leaf(d, lower(d.text)) if zlib.crc32(str(d.doc_id).encode()) % 5 == 0 else x
        for left, right in path:
            at = sha(left + at + right)
        r = got[d.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (x, sub, root, sha("".join(a + b for a, b in path)), at, at == root)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    assert sorted(con.execute(queries.oracle_sql()["op12_merkle"]).fetchall()) == sorted(tuple(r) for r in got.values())


# ---- periodic runs
def brute_runs(s, length=24, exponent=3):
    out = []
    s = np.asarray(s)
    for q in range(1, len(s) // exponent + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], s[q:] == s[:-q], [0]]).astype(int)))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist()):
            n = b - a + q
            w = s[a : a + n]
            if n >= max(length, exponent * q) and not any((w[d:] == w[:-d]).all() for d in range(1, q)):
                out.append((a, n, q))
    return sorted(out)


def periodic_sequences(r, count):
    for _ in range(count):
        n, letters = r.randrange(0, 160), r.choice([1, 2, 2, 3, 5])
        s = [r.randrange(letters) for _ in range(n)]
        if n > 6 and r.random() < 0.6:
            a, p = r.randrange(n // 2), r.randrange(1, max(2, n // 5))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
            if r.random() < 0.5:
                s[r.randrange(n)] = 9
        yield s


def test_runs_equal_brute_force(monkeypatch):
    for s in periodic_sequences(random.Random(7), 400):
        assert periodic.runs(np.array(s, int)) == brute_runs(s)
    monkeypatch.setattr(periodic, "MIN_LENGTH", 2)
    monkeypatch.setattr(periodic, "MIN_EXPONENT", 2)  # all maximal repetitions
    for s in periodic_sequences(random.Random(8), 400):
        assert periodic.runs(np.array(s, int)) == brute_runs(s, 2, 2)


def test_vocabulary_holds_every_square():
    """Squares after suffix-link steps are all distinct squares with a primitive half, and only these."""
    for s in periodic_sequences(random.Random(9), 60):
        if len(s) > 1:
            t = periodic.SuffixTree(np.array(s))
            start, k, more = periodic.covering_squares(t)
            found = {tuple(s[i + j : i + j + 2 * p]) for i, p, m in zip(start.tolist(), k.tolist(), more.tolist()) for j in range(m + 1)}
            every = {tuple(s[i : i + 2 * p]) for i in range(len(s)) for p in range(1, (len(s) - i) // 2 + 1) if s[i : i + p] == s[i + p : i + 2 * p]}
            assert found == every


def test_long_sequences():
    r = np.random.default_rng(1)
    s = r.integers(0, 5000, 150_000)
    s[30_000:] = s[30_000 + np.arange(120_000) % 17_000]
    assert periodic.runs(s) == [(30_000, 120_000, 17_000)]
    assert periodic.runs(np.zeros(50_000, int)) == [(0, 50_000, 1)]


def plain_collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_find_runs_edges(spark):
    texts = ["a " * 23, "a " * 24, "lead " + "a b c " * 8 + "tail", "a b c d e f g h i " * 2, None, "", " \n\t", "é x " * 30, "x", "one\ntwo\rthree\x0bfour\x0cfive\tsix " * 5]
    rows = [(i, t, None, None, 0, *EXTRA) for i, t in enumerate(texts)] + [(None, texts[2], None, None, 0, *EXTRA)] * 2
    got = periodic.find_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    for r in got:
        w = words(texts[2 if r.doc_id is None else r.doc_id])
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        found = brute_runs([number[x] for x in w])
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed.encode()) == (len(w), found, plain_collapse(w, found))
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    many = spark.createDataFrame([([(0, 30, 3), (5, 40, 4), (9, 70, 7)],), ([],)], "runs array<struct<start:bigint,length:bigint,period:bigint>>").select(periodic.best_run(F.col("runs")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in many] == [(0, 30, 3), None]


def test_op13(spark, docs):
    got = {r.doc_id: r for r in queries.queries()["op13_periodic"](spark, SF).collect()}
    assert len(got) == len(docs) and any(r.n_runs for r in got.values())
    for d in docs:
        w, h = words(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        found = brute_runs([number[x] for x in w])
        r = got[d.doc_id]
        best = (None,) * 4
        for s, length, q in found:
            if best[0] is None or length * best[2] > best[1] * q:
                best = (s, length, q, 1000 * length // q)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *best)
        assert (r.runs_sha256, r.collapsed_sha256) == (sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(plain_collapse(w, found)))


# ---- names and ids of other operators
def test_deduplicate_keeps_columns_that_clash_with_its_own(spark):
    rows = [(1, "one two three four five", 7, "a", 1.5), (2, "one two three four five", 8, None, None), (3, "quite another text here now", 9, "c", 2.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp int, __n string, fp double")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
    assert simhash.deduplicate(df.limit(0)).columns == df.columns


def test_pieces_take_ids_of_any_type(spark):
    for kind, ids in (("string", ["a", "7", None]), ("double", [1.5, 2.0, None]), ("int", [1, 2, None])):
        df = spark.createDataFrame([(i, "some words to cut in pieces") for i in ids], f"doc_id {kind}, text string")
        got = pieces.sample(df, queries.TOKENIZER).collect()
        assert {r.doc_id for r in got} == set(ids) and all(r.round_trip for r in got)
    assert pieces.row_key(5) == 5 and pieces.row_key(None) == -1 and pieces.row_key("a") != pieces.row_key("b")
