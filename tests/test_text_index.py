import random

import pytest
from pyspark.sql import functions as F

from memloom.engine import MemoryEngine
from memloom.functions import text as t
from memloom.operators import search, text_index
from memloom.operators.tables import new_path
from memloom.operators.versions import Conflict, Manifest
from memloom.sources import views as v
from tests.conftest import DATA
from tests.test_search import QUERIES, corpus


@pytest.fixture(scope="module")
def index(spark):
    """An index after additions, replacements and removals; and the rows that it should hold."""
    stem = lambda c: t.stemmed_tokens(c)
    out = text_index.TextIndex(spark, new_path(spark, "index"), ["id"], stem, t.Porter.stem)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    rows = dict(corpus(120, 3))
    out.add(frame(list(rows.items())))
    later = {i: x for i, x in corpus(90, 9) if i % 3 == 0} | {500: "naïve tests, running", 501: None, 502: "", 503: "!!!"}
    out.add(frame(list(later.items())))
    out.remove(frame([(i, "") for i in range(5, 25)]).select("id"))
    rows = {i: x for i, x in (rows | later).items() if not 5 <= i < 25}
    return out, frame(list(rows.items()))


MORE = ["running", "happi", "test OR run OR national", "(test AND run) OR connect", "zebra", "zebra OR run", "run run", "na*", "* OR run", '"" OR run', "NOT"]


@pytest.mark.parametrize("query", QUERIES + MORE)
def test_like_the_scan(spark, index, query):
    found, rows = index
    got = [(r.id, round(r.score, 9)) for r in found.search(query, 20).collect()]
    want = [(r.id, round(r.score, 9)) for r in search.keyword_search(rows, query, ["id"], t.stemmed_tokens(F.col("text")), 20).collect()]
    assert got == want


def test_filters_and_lenient_queries(spark, index):
    found, rows = index
    among = rows.filter("id % 4 = 1")
    for query in ("run OR test", '"the and"', "run's"):
        got = [(r.id, round(r.score, 9)) for r in found.search(query, 10, among.select("id"), "lenient").collect()]
        want = search.keyword_search(rows, query, ["id"], t.stemmed_tokens(F.col("text")), 10, F.col("id") % 4 == 1, "lenient").collect()
        assert got == [(r.id, round(r.score, 9)) for r in want], query


def test_blocks_are_left_out_and_merging_keeps_results(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_BITS", 3)
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 2)
    rng = random.Random(4)
    rows = [(i, " ".join(["rare"] * (i % 5 == 0 if i % 97 else 40) + ["other"] * (i % 7 == 0) + ["filler"] * rng.randint(20, 60))) for i in range(800)]
    table = spark.createDataFrame(rows, "id long, text string").repartition(2)
    index = text_index.TextIndex(spark, new_path(spark, "index"), ["id"], t.plain_tokens)
    index.add(table.filter("id < 500"))
    index.add(table.filter("id >= 400"))  # a fifth of them again
    plain = lambda found: [(r.id, round(r.score, 9)) for r in found.collect()]
    want = plain(search.keyword_search(table, "rare", ["id"], t.plain_tokens(F.col("text")), 5, stem=str))
    assert plain(index.search("rare", 5)) == want
    assert 90 <= index.blocks_there and index.blocks_read <= index.blocks_there // 4
    n, average = index.statistics()
    index.merge()
    index.vacuum()
    assert plain(index.search("rare", 5)) == want and index.statistics() == (n, average)
    index.remove(table.select("id"))
    assert index.search("rare", 5).count() == 0 and index.statistics() == (0, 0.0)


def test_only_the_shards_and_row_groups_of_a_word_are_read(spark, index):
    found, _ = index
    _, now = found.manifest.read()
    plan = found._of(found._table(now, "postings"), ["run"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "(term#" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,run)]" in plan


def test_nothing_indexed(spark):
    index = text_index.TextIndex(spark, new_path(spark, "index"), ["id"], t.plain_tokens)
    index.add(spark.createDataFrame([], "id long, text string"))
    assert index.search("a", 5).collect() == [] and index.search('"a b"', 5).collect() == []


def test_the_engine_searches_its_index(spark):
    sf = f"{DATA}/sf0.001"
    messages = v.messages(spark, sf).filter("conv_key is not null and native_id is not null").dropDuplicates(["conv_key", "native_id"])
    scan = MemoryEngine(spark, {"messages": messages})
    index = MemoryEngine.message_index(spark, new_path(spark, "index"))
    index.add(messages)
    fast = MemoryEngine(spark, {"messages": messages}, index)
    for query in ("the AND of", "running OR that"):
        one, two = (sorted((r.conv_key, r.native_id, r.score) for r in e.search_memory(query, source="claude.ai").collect()) for e in (scan, fast))
        assert one == two and one


def test_one_of_two_writers_wins(spark):
    m = Manifest(spark, new_path(spark, "manifest"))
    assert m.read() == (0, {})
    m.write(1, {"a": ["é"]})
    with pytest.raises(Conflict):
        m.write(1, {"b": 1})
    assert m.read() == (1, {"a": ["é"]})
    for n in range(2, 6):
        m.write(n, {"n": n})
    m.prune(2)
    assert m.versions() == [4, 5] and m.read() == (5, {"n": 5})
