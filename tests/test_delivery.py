import datetime
import json

from pyspark.sql import functions as F

from memloom.engine import MemoryEngine
from memloom.operators import delivery, edges


def test_cursor(spark):
    rows = spark.createDataFrame([(f"k{i}", f"2024-01-{(i + 1) // 2:02d}") for i in range(1, 61)], "key string, updated_at string")
    cursor, seen = "2024-01-03", []
    for _ in range(4):
        page = delivery.changed_since(rows, cursor, 25)
        seen += [r.key for r in page.collect()]
        cursor = delivery.next_cursor(page, cursor).collect()[0].cursor
    assert sorted(seen) == sorted(f"k{i}" for i in range(7, 61)) and cursor == "2024-01-30"
    assert len(delivery.changed_since(rows, "2024-01-03", 25).collect()) == 26
    assert delivery.next_cursor(page.limit(0), "2024-01-03").collect()[0].cursor == "2024-01-03"


def test_delivery_stops_at_the_first_failure(spark, tmp_path):
    queue = spark.createDataFrame([(f"k{i}", f"t{i}", int(i == 0)) for i in range(5)], "key string, updated_at string, shipped int")
    assert [r.key for r in delivery.pending(queue, 2).collect()] == ["k1", "k2"]
    outcome = spark.createDataFrame([("k1", 1, True), ("k2", 2, False), ("k3", 3, True)], "key string, seq int, ok boolean")
    assert {r.key for r in delivery.delivered(queue, outcome).filter("shipped = 1").collect()} == {"k0", "k1"}
    delivery.write_ndjson(queue, str(tmp_path / "out"))
    assert {json.loads(r.value)["key"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {f"k{i}" for i in range(5)}


def test_observed_metrics(spark):
    rows, watch = delivery.observed(spark.range(10), "progress", total=F.sum("id"))
    rows.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 10, "total": 45}


def test_typing_status(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(1, i, 1 + i % 3, i < 10, now - datetime.timedelta(seconds=100 * i) if i < 10 else None) for i in range(15)], "src int, dst int, weight int, verified boolean, verified_at timestamp_ntz")
    r = edges.typing_status(rows, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).collect()[0]
    assert (r.total, r.typed, r.remaining, r.pct, r.rate_per_s, r.eta_seconds) == (10, 6, 4, 60.0, round(4 / 300, 3), 300)
    assert edges.typing_status(rows.filter("not verified"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).collect()[0].eta_seconds is None
    assert [x.dst for x in edges.recent_typings(rows.filter("verified"), 2).collect()] == [0, 1]


def test_engine(spark):
    messages = spark.createDataFrame([("a", f"m{i}", i, "user", f"2024-01-0{i + 1}", f"apples and pears {i}", "unknown", "s", True) for i in range(5)] + [("b", "m0", 0, "user", "2024-01-01", "apples", "sealed", "s", True)], "conv_key string, native_id string, pos int, role string, created_at string, text string, owner string, source string, on_active_path boolean")
    vectors = messages.select("conv_key", "native_id", "owner", "source", "created_at", F.array(F.col("pos").cast("double"), F.lit(1.0)).alias("embedding"))
    entities = spark.createDataFrame([(1, "Ann", "person", 5), (2, "Bob", "person", 3), (3, "Cat", "topic", 2)], "entity_id long, canonical string, type string, mentions long")
    edge = spark.createDataFrame([(1, 3, 2, "fact", None, None, None, None, "a", "b"), (2, 3, 4, "fact", "uses", "backward", "state", "2024", "a", "b"), (1, 2, 1, "fact", None, None, None, None, "a", "b")], "src long, dst long, weight long, relation string, verified_relation string, direction string, temporality string, as_of string, first_seen string, last_seen string")
    aliases = spark.createDataFrame([("annie", 1)], "alias string, entity_id long")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "entity_id long, community_id int")
    engine = MemoryEngine(spark, {"messages": messages, "vectors": vectors, "entities": entities, "edges": edge, "aliases": aliases, "members": members})
    hits = engine.search_memory("apples", [1.0, 0.0]).collect()
    assert hits and all(r.conv_key == "a" for r in hits) and {r.via for r in hits} <= {"both", "keyword", "semantic"}
    assert [r.native_id for r in engine.get_conversation("a#m2", 1).collect()] == ["m1", "m2", "m3"]
    assert engine.get_conversation("b#m0").count() == 0
    assert engine.get_message("a#m1", 9).collect()[0].text == "apples and pears 1"
    assert [(r.src, r.dst) for r in engine.entity_neighborhood("annie").collect()] == [(1, 3), (1, 2)]
    assert [r.sentence for r in engine.entity_neighborhood("Cat").collect()] == ["Cat uses Bob (as of 2024)", "Ann fact Cat"]
    assert [(r.kind, r.name, r.weight) for r in engine.what_connects("Ann", "bob").collect()] == [("direct", "Ann fact Bob", 1), ("shared", "Cat", 6)]
    assert engine.what_connects("Ann", "nobody").count() == 0 and engine.what_connects("Ann", "ann").count() <= 2
    assert [r.canonical for r in engine.theme_of("Bob").orderBy("rank").collect()] == ["Ann", "Bob"]
