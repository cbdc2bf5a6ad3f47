"""Core queries on tables that go on beyond the given ones, against their SQL."""

import duckdb

from memloom.plans import registry


def turns(spark, tmp_path, ids):
    """conversations with these ids, of three turns each, in a folder of their own."""
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"words of {i} and {t}. More?") for i in ids for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    return con


def same(spark, con, tmp_path, name):
    got, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
    order = sorted(want.columns)
    rows = lambda columns, data: sorted(repr([dict(zip(columns, r, strict=True))[c] for c in order]) for r in data)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_later_versions_of_conversations_beyond_their_time(spark, tmp_path):
    """Conversation 8784 begins with 2025, the time of the later versions."""
    con = turns(spark, tmp_path, [0, 1, 6, 7, 8782, 8783, 8784, 8785, 8786, 8787, 8790, 20000])
    same(spark, con, tmp_path, "ingest_upsert")


def test_tasks_that_make_pairs_do_not_grow(spark):
    """Parts follow the rows and stay the parts of the grouping: no second exchange, which adaptive execution would coalesce."""
    from memloom.operators import edges

    mapped = spark.range(40_000).selectExpr("id div 4 as conv_key", "0 as chunk_idx", "id % 50 as entity_id", "'' as day")
    rows = edges.chunk_entities(edges.dealt(mapped, 1000))
    assert rows.rdd.getNumPartitions() == 40
    assert max(n for n in rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < 1000
