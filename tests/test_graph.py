import random

from pyspark.sql import functions as F

from memloom.operators import communities, edges, resolve


def cliques(k=6, size=5):
    rows = [(a, b, 1) for c in range(k) for a in range(c * size, (c + 1) * size) for b in range(a + 1, (c + 1) * size)]
    return rows + [(c * size, (c + 1) * size, 1) for c in range(k - 1)]


def test_planted_cliques_are_found(spark):
    frame = spark.createDataFrame(cliques(), "src long, dst long, weight long")
    one = {r.node: r.community for r in communities.louvain(frame).collect()}
    assert len(one) == 30
    assert len({one[n] for n in one}) == 6
    assert all(len({one[c * 5 + i] for i in range(5)}) == 1 for c in range(6))
    again = {r.node: r.community for r in communities.louvain(frame.orderBy(F.rand(3))).collect()}
    assert one == again


def test_modularity_of_one_and_of_all(spark):
    links = communities._undirected(spark.createDataFrame(cliques(2), "src long, dst long, weight long"))
    nodes = links.select(F.col("a").alias("node")).distinct()
    assert abs(communities.modularity(links, nodes.withColumn("c", F.lit(0)))) < 1e-12
    assert communities.modularity(links, nodes.withColumn("c", F.floor(F.col("node") / 5))) > 0.4


def test_no_edges(spark):
    assert communities.louvain(spark.createDataFrame([], "src long, dst long, weight long")).collect() == []


def test_pairs_are_ordered_and_bounded(spark):
    rng = random.Random(2)
    rows = [("c", rng.randrange(8), rng.randrange(12), f"2024-01-0{rng.randint(1, 9)}") for _ in range(80)]
    mapped = spark.createDataFrame(rows, "conv_key string, chunk_idx int, entity_id long, day string")
    said = spark.createDataFrame([("c", i, i * 10 + j, "ab"[j % 2]) for i in range(7) for j in range(3)], "conv_key string, chunk_idx int, id long, type string")
    got = edges.edges(mapped, said).collect()
    chunk_count = len({r[1] for r in rows} & set(range(7)))
    assert got and all(r.src < r.dst and r.weight <= chunk_count and r.relation == "a" and len(r.evidence) <= 20 for r in got)
    assert all(r.first_seen <= r.last_seen for r in got)


def test_typing_guard(spark):
    rows = [("family-of", "forward", "person", "person", ["x", "his sister"]), ("family-of", "forward", "person", "person", ["they met"]), ("works-for", "backward", "org", "person", None), ("works-for", "forward", "org", "person", None), ("works-on", "forward", "person", "tool", None), ("nonsense", "forward", "person", "person", None), ("uses", "sideways", "person", "person", None)]
    got = edges.guard_typing(spark.createDataFrame(rows, "relation string, direction string, src_type string, dst_type string, evidence array<string>")).collect()
    assert [(r.relation, r.direction, r.downgraded) for r in got] == [("family-of", "forward", False), ("discussed-with", "undirected", True), ("works-for", "backward", False), ("related-to", "undirected", True), ("works-on", "forward", False)]


def test_timeline_by_aliases(spark):
    e = spark.createDataFrame([(1, "Ann Lee (boss)", "person", 5), (2, "Bo", "person", 2)], "entity_id long, canonical string, type string, mentions long")
    a = spark.createDataFrame([("A. Lee", 1), ("annie", 1)], "alias string, entity_id long")
    m = spark.createDataFrame([("c", 0, 1), ("d", 0, 1), ("s", 0, 1), ("c", 1, 2)], "conv_key string, chunk_idx int, entity_id long")
    said = [(1, "c", 0, "fact", "Annie came", "user", ["m1"]), (2, "c", 0, "fact", "Joannie came", "user", []), (3, "d", 0, "fact", "met A. Lee", "both", None), (4, "s", 0, "fact", "Annie hid", "user", []), (5, "c", 1, "fact", "Annie left", "user", []), (6, "c", 0, "fact", "ann lee ran", "assistant", []), (7, "c", 0, "fact", "Annie came", "user", ["m1"])]
    s = spark.createDataFrame(said, "id long, conv_key string, chunk_idx int, type string, statement string, speaker string, evidence array<string>")
    c = spark.createDataFrame([("c", "me", "2024-02-01T00"), ("d", "me", "2024-01-01T00"), ("s", "sealed", "2023-01-01T00")], "conv_key string, owner string, created_at string")
    got = resolve.timeline("annie", e, a, m, s, c).collect()
    assert [(r.day, r.statement, r.ref) for r in got] == [("2024-01-01", "met A. Lee", None), ("2024-02-01", "ann lee ran", None), ("2024-02-01", "Annie came", "c#m1")]
    assert [r.statement for r in resolve.timeline("annie", e, a, m, s, c, " Agent").collect()] == ["ann lee ran"]


def test_resolution_tiers(spark):
    e = spark.createDataFrame([(1, "Ann Lee", 5), (2, "Ann Poe", 9), (3, "ann", 1), (4, "Bob Ray (x)", 2)], "entity_id long, canonical string, mentions long")
    a = spark.createDataFrame([("AL", 1), ("al", 2), ("Robert", 4)], "alias string, entity_id long")
    q = spark.createDataFrame([("ANN",), ("ann lee",), ("bob",), ("al",), ("robert",), ("zed",)], "name string")
    got = {r.name: (r.entity_id, r.tier) for r in resolve.resolve_names(q, e, a).collect()}
    assert got == {"ANN": (3, 1), "ann lee": (1, 1), "bob": (4, 2), "al": (2, 3), "robert": (4, 3)}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    names = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))) for i in range(60)]
    got = {(r.a, r.b) for r in resolve.near_duplicate_names(spark.createDataFrame(names, "entity_id long, canonical string")).collect()}
    assert got == {(i, j) for i, x in names for j, y in names if i < j and (x in y or y in x) and abs(len(x) - len(y)) <= 8}


def test_splits_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(9)], "id long, embedding array<double>")
    c = spark.createDataFrame([(f"c{k}", [float(i == k) for i in range(3)]) for k in range(3)], "canonical string, embedding array<double>")
    for bound in (10, 1):
        assert {r.id: r.canonical for r in resolve.assign_splits(v, c, bound).collect()} == {i: f"c{i % 3}" for i in range(9)}
