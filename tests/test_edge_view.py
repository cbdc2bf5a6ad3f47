import random

import pytest

from memloom.operators import edge_view, edges
from memloom.operators.tables import new_path

MAPPED = "conv_key string, chunk_idx int, entity_id long, day string"
SAID = "conv_key string, chunk_idx int, id long, type string"


def content(rng, ids):
    """What a chunk says: entities with days, assertions with types."""
    return [(rng.randrange(8), f"2024-01-0{rng.randint(1, 9)}") for _ in range(rng.randint(0, 5))], [(next(ids), rng.choice(["a", "b", None])) for _ in range(rng.randint(0, 4))]


def frames(spark, chunks):
    mapped = [(c, i, e, d) for (c, i), (es, _) in chunks.items() for e, d in es]
    said = [(c, i, a, t) for (c, i), (_, xs) in chunks.items() for a, t in xs]
    return spark.createDataFrame(mapped, MAPPED), spark.createDataFrame(said, SAID)


def plain(df):
    return sorted(map(repr, df.select("src", "dst", "weight", "relation", "evidence", "first_seen", "last_seen").collect())) if df is not None else []


@pytest.mark.parametrize("seed", [1, 2])
def test_any_sequence_of_submits_is_a_rebuild(spark, seed):
    rng, ids, now = random.Random(seed), iter(range(10_000)), {}
    view = edge_view.EdgeView(spark, new_path(spark, "view"), evidence_cap=4)
    for number in range(5):
        touched = [(f"c{rng.randrange(3)}", rng.randrange(3)) for _ in range(rng.choice((1, 3, 6)))]
        new = {k: content(rng, ids) for k in touched if rng.random() < 0.7}
        now = {k: x for k, x in now.items() if k not in touched} | new
        args = (number, spark.createDataFrame(touched, "conv_key string, chunk_idx int"), *frames(spark, new))
        view.submit(*args)
        if number == 2:  # the same one again changes nothing
            view.submit(*args)
        assert plain(view.table()) == plain(edges.edges(*frames(spark, now), evidence_cap=4)), number


def test_a_killed_submit_is_repeated(spark, monkeypatch):
    rng, ids = random.Random(5), iter(range(1000))
    one = {("c", i): content(rng, ids) for i in range(4)}
    two = {("c", 1): content(rng, ids), ("c", 2): ([], [])}
    view = edge_view.EdgeView(spark, new_path(spark, "view"))
    touched = lambda x: spark.createDataFrame(list(x), "conv_key string, chunk_idx int")
    view.submit(0, touched(one), *frames(spark, one))

    def lost(*_):
        raise RuntimeError("lost")

    for log in (view.shares, view.edges, view.chunks):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(log, "append", lost)
            view.submit(1, touched(two), *frames(spark, two))
    again = edge_view.EdgeView(spark, view.path)
    again.submit(1, touched(two), *frames(spark, two))
    assert plain(again.table()) == plain(edges.edges(*frames(spark, one | two)))


def test_what_is_written_follows_the_submit(spark):
    rng, ids = random.Random(6), iter(range(100_000))
    many = {(f"c{i}", 0): ([(e, "2024-01-01") for e in (i, i + 1, i + 2)], [(next(ids), "a")]) for i in range(60)}
    view = edge_view.EdgeView(spark, new_path(spark, "view"))
    view.submit(0, spark.createDataFrame(list(many), "conv_key string, chunk_idx int"), *frames(spark, many))
    one = {("c7", 0): ([(7, "2024-01-01"), (8, "2024-01-01")], [(next(ids), "b")])}
    view.submit(1, spark.createDataFrame(list(one), "conv_key string, chunk_idx int"), *frames(spark, one))
    rows = {log: [r["rows"] for r in getattr(view, log).manifest.read()[1]["runs"]] for log in ("chunks", "shares", "edges")}
    assert rows == {"chunks": [60, 1], "shares": [180, 3], "edges": [121, 3]}
    assert plain(view.table()) == plain(edges.edges(*frames(spark, many | one)))


def test_parts_follow_the_rows(spark, monkeypatch):
    """Logs and submits are dealt into parts of bounded rows, which adaptive execution would make larger the more there are."""
    from memloom.operators import upsert_log

    monkeypatch.setattr(upsert_log, "PART_ROWS", 200, raising=False)
    chunks = [(f"c{i}", 0) for i in range(1000)]
    mapped = spark.createDataFrame([(c, i, e, "2024-01-01") for c, i in chunks for e in (1, 2)], MAPPED)
    said = spark.createDataFrame([(c, i, n, "a") for n, (c, i) in enumerate(chunks)], SAID)
    view = edge_view.EdgeView(spark, new_path(spark, "view"))
    view.submit(0, spark.createDataFrame(chunks, "conv_key string, chunk_idx int"), mapped, said)
    view.submit(1, spark.createDataFrame(chunks[:1], "conv_key string, chunk_idx int"), mapped.limit(0), said)
    rows = view.shares.table()
    sizes = rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) == 6 and sum(sizes) == 1000 and max(sizes) < 300
    assert [tuple(r)[:3] for r in view.table().collect()] == [(1, 2, 999)]
