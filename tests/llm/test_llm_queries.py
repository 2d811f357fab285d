"""Every corpus query as registered, on the whole smallest tables, against versions written out in plain Python (or SQL)."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gaugeworks.llm import line_dedup, queries
from gaugeworks.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(table(spark, SF, "documents").collect(), key=lambda r: r.doc_id)


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.queries()[name](spark, SF).collect()


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """Least id reachable by links of four or fewer differing bits, of (id, fingerprint) rows."""
    of = {d: d for d, _ in rows}
    fps = dict(rows)
    changed = True
    while changed:
        changed = False
        for a in of:
            for b in of:
                if of[b] < of[a] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    of[a], changed = of[b], True
    return of


def test_op2(docs, run):
    fps = {d.doc_id: fingerprint(d.text) for d in docs}
    of = components(list(fps.items()))
    got = run("op2_simhash")
    assert len(got) == len(docs) and all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", of[r.doc_id]) for r in got)


def test_op3(docs, run):
    got = {r.doc_id: r for r in run("op3_minhash")}
    text = [d.text or "" for d in docs]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))} if words(t) else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    off = []
    for i, d in enumerate(docs):
        nxt = text[(i + 1) % len(text)]
        n = len(text[i])
        edited = text[i][: n - n // 4] + nxt[: n // 4]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        off += [abs(r.near_edited - like(grams(text[i]), grams(edited))), abs(r.near_next - like(grams(text[i]), grams(nxt)))]
    assert np.mean(off) < 0.03 and max(off) < 0.2
    same = defaultdict(set)
    for d, t in zip(docs, text):
        same[t].add(got[d.doc_id].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_op4(docs, run):
    got = {r.doc_id: r for r in run("op4_langid")}
    langs = {d.lang for d in docs if d.lang}
    right = []
    for d in docs:
        r = got[d.doc_id]
        held = zlib.crc32(str(d.doc_id).encode()) % 4 == 2
        assert r.held_out == held and 0 <= r.score <= 1 and r.lang_pred in langs | {"und"}
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or ""))
        if held and d.lang and r.lang_pred != "und":
            right.append(r.lang_pred == d.lang)
    assert np.mean(right) > 0.95


def test_op5(docs, run):
    got = {r.doc_id: r for r in run("op5_quality")}
    p = {d.doc_id: got[d.doc_id].p_doc for d in docs}
    path, host = defaultdict(list), defaultdict(list)
    for d in docs:
        path[d.source, d.lang].append(p[d.doc_id])
        host[d.source].append(p[d.doc_id])
    n = len(docs)
    rate = (sum(p.values()) + 0.5) / (n + 1)
    strength = lambda rows: min(1e4, max(1.0, rate * (1 - rate) / max(1e-6, sum(len(v) * (np.mean(v) - at) ** 2 - rate * (1 - rate) for v, at in rows) / sum(len(v) for v, _ in rows)) - 1))
    kh = strength([(v, rate) for v in host.values()])
    kp = strength([(v, np.mean(host[s])) for (s, _), v in path.items()])
    logit = lambda x: np.log(x / (1 - x))
    for d in docs:
        own, h, q = p[d.doc_id], host[d.source], path[d.source, d.lang]
        ph = min(1 - 1e-6, max(1e-6, (sum(h) - own + kh * rate) / (len(h) - 1 + kh)))
        pp = min(1 - 1e-6, max(1e-6, (sum(q) - own + kp * ph) / (len(q) - 1 + kp)))
        score = 1 / (1 + np.exp(-(logit(own) + logit(pp) - logit(rate))))
        r = got[d.doc_id]
        assert np.allclose([r.p_host, r.p_path, r.score], [ph, pp, score], rtol=1e-4, atol=1e-6) and r.kept == (r.score >= 0.35)


def test_op6(docs, run):
    got = {r.doc_id: r for r in run("op6_quality_rules")}
    for d in docs:
        t, w = d.text or "", words(d.text)
        lines = [x for x in t.split("\n")]
        dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = len({i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)})
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, again)
        assert r.base_failed == (len(w) < 50 or 100 * again > 50 * len(w)) and not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_op7_and_op1(docs, run):
    seven = run("op7_pieces")
    assert all(r.round_trip and 0 < r.inclusion <= 1 for r in seven) and {r.doc_id for r in seven} == {d.doc_id for d in docs}
    assert all(k == 1 for k in Counter((r.doc_id, r.ids_hash) for r in seven).values())
    one = {r.doc_id: r for r in run("op1_lm_score")}
    assert all(one[d.doc_id].n_words == len(words(d.text)) for d in docs) and len(one) == len(docs)


def test_op8(docs, run):
    got = {r.doc_id: r for r in run("op8_substring_dedup")}
    every = {d.doc_id: words(d.text) for d in docs}
    count = Counter(tuple(w[i : i + 35]) for w in every.values() for i in range(len(w) - 34))
    for d, w in every.items():
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op9(run):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(queries.oracle_sql()["op9_line_dedup"]).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in run("op9_line_dedup"))


def test_op10(docs, run):
    got = {r.doc_id: r for r in run("op10_mixing")}
    size = Counter()
    for d in docs:
        size[d.source] += len(words(d.text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, total = {}, set(order), float(sum(size.values()))
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for d in docs:
        r = got[d.doc_id]
        assert (r.size, r.source_size) == (len(words(d.text)), size[d.source]) and abs(r.target - target[d.source]) < 1e-6 * max(1, target[d.source])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[d.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 5 for s in target)


def test_pipeline(spark, docs):
    """The stages of the pipeline on whole tables, each against its plain version on the rows that its predecessor kept."""
    kept = {r.doc_id for r in queries.queries()["op5_quality"](spark, SF).where("kept").collect()}
    now = [d.asDict() for d in docs if d.doc_id in kept]
    pages, seen = Counter(d["source"] for d in now), Counter()
    bare = lambda x: x.strip(" \t\r")
    for d in now:
        seen.update({(d["source"], bare(x)) for x in (d["text"] or "").split("\n")})
    bad = lambda s, x: bare(x) != "" and seen[s, bare(x)] >= line_dedup.MIN_PAGES and seen[s, bare(x)] > line_dedup.RATIO * pages[s]
    for d in now:
        if d["text"] is not None:
            d["text"] = "\n".join(x for x in d["text"].split("\n") if not bad(d["source"], x))
            d["n_chars"] = len(d["text"])
    of = components([(d["doc_id"], fingerprint(d["text"])) for d in now])
    now = [d for d in now if of[d["doc_id"]] == d["doc_id"]]
    stage, got = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        stage = materialize(f(spark, stage, SF), "test-stage")
        got.append(stage)
    columns = table(spark, SF, "documents").columns
    assert all(x.columns == columns for x in got[:-1])
    key = lambda d: (d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"])
    assert sorted(map(key, now)) == sorted(key(r.asDict()) for r in got[2].collect())
    drawn = Counter(r.doc_id for r in got[3].collect())
    assert drawn and max(drawn.values()) <= 3 and set(drawn) <= {d["doc_id"] for d in now}
    pieces = got[4].collect()
    assert all(r.round_trip for r in pieces) and set(drawn) == {r.doc_id for r in pieces}
    assert Counter(r.doc_id for r in pieces if r["sample"] == 1) == drawn
    assert sorted((r.doc_id, r["sample"], tuple(r.ids)) for r in pieces) == sorted((r.doc_id, r["sample"], tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_null_and_repeated_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = table(spark, SF, "documents").schema
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", None, "a", 3), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13)]
    out = stage(spark, spark.createDataFrame(rows, schema), SF)
    assert {r.doc_id for r in out.collect()} <= {1, 2, 3, None}
