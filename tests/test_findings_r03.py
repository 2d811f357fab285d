"""What the third round's findings showed: each would have failed before."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks import queries
from gaugeworks.functions import similarity, text, translation
from gaugeworks.operators import corpus, sentences
from gaugeworks.operators.gram_store import GramStore
from gaugeworks.sources import offset_text

SQL = queries.oracle_sql()


def both(spark, folder, name):
    """The rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, str(folder))
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, con.execute(SQL[name]).fetchall()))


@pytest.mark.parametrize("name", ["contamination_13gram", "contaminated_items_13gram", "contamination_clean_split", "ngram_match_stats", "janitor_clean", "ngram_doc_frequency_8"])
def test_capitals_outside_of_ascii_are_lowered(spark, tmp_path, name):
    con = duckdb.connect()
    run = " ".join(f"Élan{i} ÑANDÚ, ΟΔΟΣ İz" for i in range(5))
    con.execute(f"COPY (SELECT i AS doc_id, repeat('other words here ', 40) || CASE WHEN i % 2 = 0 THEN '{run}' ELSE lower('{run}') END || repeat(' more of them', 60) AS text FROM range(12) AS x(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT 1 AS item_id, upper('{run}') AS text) TO '{tmp_path}/benchmark.parquet'")
    con.execute(f"COPY (SELECT i AS doc_id, (i % 3 = 0)::INT AS quality FROM range(14) AS x(i)) TO '{tmp_path}/labels.parquet'")
    got, wanted = both(spark, tmp_path, name)
    assert got == wanted and got


def test_store_keeps_only_what_will_be_asked(spark, tmp_path):
    d = spark.createDataFrame([(0, "a b c d e f"), (1, "x b C d"), (2, None), (3, "q r s t")], "offset long, text string")
    for most in (None, 0):
        store = GramStore(spark, f"among_{most}", 3, 4, f"file://{tmp_path}")
        try:
            hashes, about = corpus.counted_hashes(spark.createDataFrame([("b, c d",)], "text string"), 3)
            store.append(d, "all", among=corpus.gram_side(hashes, about, most))
            assert {tuple(r) for r in store.rows().collect()} >= {("b c d", 0, "all"), ("b c d", 1, "all")}
            assert store.rows().count() < 7  # of all n-grams
        finally:
            store.drop()


def test_sentences_by_broadcast_and_by_join(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Dr.", "etc.", "x.", "5.", "The", "He", "word", "stop.", "why?", "no!", "*a*\n"]) for _ in range(r.randrange(40)))) for i in range(60)] + [(60, None), (61, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = sentences.Model(spark.createDataFrame([("dr",), ("etc",)], "word string"), spark.createDataFrame([("the",)], "word string"))
    quick = sentences.sentence_counts(d, "doc_id", model)
    plan = quick._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # texts are read once
    both = sentences.enough_sentences_both(d, "doc_id", F.lit(5), F.lit("at least"), model)
    got = sorted(map(tuple, quick.collect())), sorted(map(tuple, both.collect()))
    monkeypatch.setattr(sentences, "BROADCAST_WORDS", 0)
    assert got[0] == sorted(map(tuple, sentences.sentence_counts(d, "doc_id", model).collect()))
    each = [{k: v for k, v in sentences.enough_sentences(d, "doc_id", F.lit(5), F.lit("at least"), model, loose).collect()} for loose in (False, True)]
    assert got[1] == sorted((k, each[0][k], each[1][k]) for k in each[0])


def test_edit_rate_stops_where_no_shift_can_help(monkeypatch):
    """Words that only one text has are edits whatever is shifted: no block is tried."""
    import numpy as np

    calls = []
    monkeypatch.setattr(np, "flatnonzero", lambda x, f=np.flatnonzero: calls.append(1) or f(x))
    assert translation.ter_edits("a b c d e f g h".split(), "i j k l m n o p q".split()) == 9 and not calls
    assert translation.ter_edits("c d a b".split(), "a b c d".split()) == 1 and calls


def test_code_lines_that_cannot_win_are_not_compared(monkeypatch):
    calls = []
    monkeypatch.setattr(similarity, "common_length", lambda x, y: calls.append(1) or text.common_length(x, y))
    assert similarity.best_ratio("abcdefgh", ["abcdefgz", "a" * 500]) == round(200 * 7 / 16) / 100 and len(calls) == 1
    assert similarity.best_ratio("", ["a"]) == similarity.best_ratio("a", None) == similarity.best_ratio("a", [""]) == 0.0
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(600))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a[:60]:
            last = 0
            for j, y in enumerate(b[:70], 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert text.common_length(a[:60], b[:70]) == row[min(len(b), 70)]
        assert text.common_length(a, b) == text.common_length(b[::-1], a[::-1])


def test_small_ranges_share_tasks(spark, tmp_path):
    with open(tmp_path / "a.txt", "w") as f:
        f.writelines(f"line {i}\n" for i in range(2000))
    reader = offset_text._Reader(str(tmp_path), 10)
    assert len(reader.partitions()) <= 2 * offset_text.TASKS
    assert sum(len(p.each) for p in reader.partitions()) > 1800
    got = sorted((r.place, r.line) for r in offset_text.read_lines(spark, str(tmp_path), 10).collect())
    assert [x for _, x in got] == [f"line {i}" for i in range(2000)] and got[-1][0] == sum(len(f"line {i}") + 1 for i in range(1999))


def test_right_and_wrong_texts_split_and_lower_as_their_sql(spark, tmp_path):
    gaps = [" ", "\u0085", "\u00a0", "\u1680", "\u2003", "\u2028", "\u3000", "\u000b", "\u001c", "\u001f", "\u0130", "\u000c", "\u000d"]
    r = random.Random(4)
    line = lambda gap: gap.join(r.choice(["the", "cat", "sat,", "on", "3-x", "I\u0130z", "is"]) for _ in range(9))
    rows = [(i, turn, line(gap) + " " + line(" ")) for i, gap in enumerate(gaps) for turn in range(5)] + [(None, 1, "the cat"), (None, 2, "the cat sat on"), (3, None, "the cat is on"), (4, 9, None), (4, 10, "")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet", index=False)
    got, wanted = both(spark, tmp_path, "right_and_wrong_texts")
    assert got == wanted and got
