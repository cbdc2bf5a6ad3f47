import random

from pyspark.sql import functions as F

from memloom.operators import ledger, store


def fold(rows):
    kept = {}
    for key, seq, updated, created, title, forced in sorted(rows, key=lambda r: r[1]):
        old = kept.get(key)
        if old and not forced and updated and old[1] and updated <= old[1]:
            continue
        kept[key] = (seq, updated, old[2] if old else created, title)
    return kept


def test_newest_wins_like_a_sequential_fold(spark):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(60)}", i, rng.choice([None, "", *"abcde"]), f"d{i}", f"t{i}", rng.random() < 0.1) for i in range(900)]
    frame = spark.createDataFrame(rows, "key string, seq long, updated_at string, created_at string, title string, forced boolean")
    got = {r.key: (r.seq, r.updated_at, r.created_at, r.title) for r in store.newest_wins(frame, force="forced").collect()}
    assert got == fold(rows)


def test_order_of_arrival_does_not_matter_for_distinct_times(spark):
    rows = [("k", f"2024-01-{d:02d}", f"t{d}") for d in range(1, 9)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame([(k, i, u, u, t) for i, (k, u, t) in enumerate(rows)], "key string, seq long, updated_at string, created_at string, title string")
        seen.add(store.newest_wins(frame).collect()[0].title)
    assert seen == {"t8"}


def test_paths_end_on_cycles_and_missing_leaves(spark):
    rows = [("a", "1", None), ("a", "2", "1"), ("a", "3", "1"), ("b", "1", "2"), ("b", "2", "1"), ("c", "1", None), ("c", "2", "1")]
    m = spark.createDataFrame(rows, "conv_key string, native_id string, parent_native_id string")
    leaves = spark.createDataFrame([("a", "3"), ("b", "1"), ("c", "missing")], "conv_key string, leaf string")
    marked = store.mark_active(m, leaves)
    active = {(r.conv_key, r.native_id) for r in marked.filter("on_active_path").collect()}
    assert active == {("a", "1"), ("a", "3"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "2")}
    assert store.mark_active(m, leaves, False).filter("conv_key = 'c' and on_active_path").count() == 0
    stats = {r.conv_key: (r.message_count, r.branch_points, r.abandoned) for r in store.branch_stats(marked).collect()}
    assert stats["a"] == (3, 1, 1)


def test_children_without_id_are_set_aside(spark):
    m = spark.createDataFrame([("a", "1", 0, "x"), ("a", "1", 1, "y"), ("a", None, 2, "z")], "conv_key string, native_id string, pos int, text string")
    good, aside = store.last_children(m)
    assert [r.text for r in good.collect()] == ["y"]
    assert [r.text for r in aside.collect()] == ["z"]


def test_archive_keeps_every_version(spark, tmp_path):
    rows = spark.createDataFrame([("s", "2024-01", "k", i) for i in range(3)], "source string, ingest_month string, key string, v int")
    for _ in range(2):
        store.write_archive(rows, str(tmp_path / "bronze"))
    back = spark.read.json(str(tmp_path / "bronze"))
    assert back.count() == 6
    assert {"source", "ingest_month"} <= set(back.columns)


def test_owner_filters_and_bounds(spark):
    rows = spark.createDataFrame([("sealed",), (None,), ("me",)], "owner string")
    assert rows.filter(ledger.not_excluded()).count() == 1
    assert rows.filter(ledger.not_excluded(keep_null=True)).count() == 2
    assert ledger.date_bounds("2024-01-01", "2024-01-02") == ("2024-01-01T00:00:00", "2024-01-02T23:59:59.999999")
    assert ledger.date_bounds("2024-01-01T05", "") == ("2024-01-01T05", "")
    assert (ledger.clamp(0, 25), ledger.clamp(99, 25)) == (1, 25)
    texts = spark.createDataFrame([("50% of_it",), ("50 of it",)], "t string")
    assert texts.filter(F.col("t").ilike(ledger.like_pattern("0% OF_"))).count() == 1


def test_embeddings_first_writer_wins(spark):
    batch = spark.createDataFrame([(1, "c", "m1", [1.0, 0.0]), (2, "c", "m1", [0.0, 1.0]), (3, "c", "m2", [1.0]), (4, "c", "m3", [0.0, 1.0])], "seq int, conv_key string, native_id string, embedding array<double>")
    have = spark.createDataFrame([("c", "m3")], "conv_key string, native_id string")
    assert [(r.native_id, r.embedding) for r in ledger.accept_embeddings(batch, have, 2).collect()] == [("m1", [1.0, 0.0])]


def test_long_threads_like_short_ones(spark):
    """Doubled pointers give the same paths as the walk inside a row: repeated, null, missing and circular ids too."""
    rng, rows, leaves = random.Random(5), [], []
    for c in range(40):
        for pos in range(rng.randint(1, 9)):
            rows.append((f"c{c}", pos, rng.choice([None, *"abcdefg"]), rng.choice([None, "zz", *"abcdefg"])))
        if c % 4:
            leaves.append((f"c{c}", rng.choice([None, *"abcdefgz"])))
    m = spark.createDataFrame(rows, "conv_key string, pos int, native_id string, parent_native_id string")
    ends = spark.createDataFrame(leaves, "conv_key string, leaf string")
    for fallback in (True, False):
        walk, double, both = (sorted(map(repr, store.mark_active(m, ends, fallback, w).collect())) for w in (100, 0, 5))
        assert walk == double == both


def test_a_thread_of_many_messages(spark):
    n = 50_000
    m = spark.range(n).select(F.lit("c").alias("conv_key"), F.col("id").alias("pos"), F.concat(F.lit("m"), F.col("id")).alias("native_id"), F.when(F.col("id") > 1, F.concat(F.lit("m"), F.col("id") - 2)).alias("parent_native_id"))
    got = store.mark_active(m, spark.createDataFrame([("c", f"m{n - 1}")], "conv_key string, leaf string"))
    assert got.filter("on_active_path").agg(F.count("*"), F.min("pos"), F.sum(F.col("pos") % 2)).first()[:] == (n // 2, 1, n // 2)
