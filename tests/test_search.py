import random
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memloom.functions import text as t
from memloom.operators import search

WORDS = "running runner runs relational relate happy happiness national nations connect connected connection café naïve test tested testing the and hopping hoped".split()


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))) for i in range(n)]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", corpus())
    return con


QUERIES = ["run", "happy the", "connect OR naive", '"the and"', "nation* NOT test", "(run OR hope) AND relate", "NEAR(run test, 3)", "text:cafe", '"happi" + the', "what's", "a-b", '"open', "run AND", "NOT run", "cat?", "other:run", "connected connection"]


@pytest.mark.parametrize("query", QUERIES)
def test_ranking_like_sqlite(spark, fts, query):
    docs = spark.createDataFrame(corpus(), "id long, text string")
    try:
        want = fts.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ? ORDER BY bm25(f), rowid LIMIT 100", (query,)).fetchall()
    except sqlite3.OperationalError:
        want = []
    got = search.keyword_search(docs, query, ["id"], t.stemmed_tokens(F.col("text")), 100).collect()
    assert {r.id: round(r.score, 6) for r in got} == {i: round(s, 6) for i, s in want}


def test_lenient_queries(spark):
    docs = spark.createDataFrame(corpus(), "id long, text string")
    toks = t.stemmed_tokens(F.col("text"))
    assert search.keyword_search(docs, "run's", ["id"], toks).count() == 0
    assert search.keyword_search(docs, "run test?", ["id"], toks, on_error="lenient").count() > 0
    assert search.keyword_search(docs, "???", ["id"], toks, on_error="lenient").count() == 0


def test_windows_and_budget(spark):
    path = spark.createDataFrame([("c", f"m{i}", i, "x" * 10) for i in range(10)], "conv_key string, native_id string, pos int, text string")
    hit = spark.createDataFrame([("c", "m4")], "conv_key string, native_id string")
    assert sorted(r.pos for r in search.context_window(path, hit, 2).collect()) == [2, 3, 4, 5, 6]
    off = spark.createDataFrame([("c", "gone")], "conv_key string, native_id string")
    assert search.context_window(path, off, 2).count() == 10
    assert search.within_budget(path, 35).count() == 3
    assert search.within_budget(path, 5).count() == 1


def test_embedder_is_deterministic_and_unit(spark):
    embed = search.hashing_embedder(64)
    rows = spark.createDataFrame([("hello world",), (None,), ("hello world",)], "text string").select(embed("text").alias("v")).collect()
    assert rows[0].v == rows[2].v
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-5


def test_stems_are_made_of_few_texts_at_a_time(monkeypatch):
    """One long batch comes out in pieces, with the stems of every text, also after words were forgotten."""
    monkeypatch.setattr(t, "STEM_WORDS", 40)
    texts = [None if i % 50 == 0 else "" if i % 50 == 1 else f"Running ponies {i} relational word{i % 97}" for i in range(3 * t.STEM_ROWS + 5)]
    pieces = list(t.stemmed_batches(iter([pd.Series(texts, dtype=object), pd.Series([], dtype=object)])))
    assert max(map(len, pieces)) <= t.STEM_ROWS
    assert [ws for p in pieces for ws in p] == [[t.Porter.stem(w) for w in t.tokens(x)] for x in texts]
