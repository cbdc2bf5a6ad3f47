import random

import pytest

from memloom.operators import communities


def test_tables_go(spark, tmp_path, monkeypatch):
    import os

    from memloom.operators import tables

    monkeypatch.setattr(tables, "shared_root", lambda _: str(tmp_path))
    monkeypatch.setattr(tables, "_written", [])
    kept = tables.Scratch(spark)
    _, b = kept.stored(spark.range(3), "a"), kept.stored(spark.range(4), "b")
    kept.drop(b)
    assert len(os.listdir(tmp_path)) == 1 and b.count() == 4
    assert tables.stored(spark.range(5), "c").count() == 5
    tables.forget(spark)
    assert os.listdir(tmp_path) == []


def test_a_local_session_without_a_folder_has_its_own(spark, monkeypatch):
    from memloom.operators import tables

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    assert tables.shared_root(Session()) == tables.shared_root(Session())


def sequential(edges, resolution=1.0):
    """Modularity of a plain run of the same method: one node after the other, then contraction."""
    import collections

    links = collections.defaultdict(lambda: collections.defaultdict(float))
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    total = sum(sum(x.values()) for x in links.values())
    home = {n: n for n in links}
    level = {a: dict(x) for a, x in links.items()}
    while True:
        c, k = {n: n for n in level}, {n: sum(x.values()) for n, x in level.items()}
        tot, moved, again = dict(k), False, True
        while again:
            again = False
            for n in sorted(level):
                to = collections.defaultdict(float)
                for m, w in level[n].items():
                    if m != n:
                        to[c[m]] += w
                tot[c[n]] -= k[n]
                best = max(sorted({c[n], *to}), key=lambda x: (round(to[x] - resolution * k[n] * tot.get(x, 0) / total, 9), x == c[n]))
                again |= best != c[n]
                moved |= best != c[n]
                c[n] = best
                tot[best] = tot.get(best, 0) + k[n]
        if not moved:
            break
        home = {n: c[h] for n, h in home.items()}
        up = collections.defaultdict(lambda: collections.defaultdict(float))
        for a, x in level.items():
            for b, w in x.items():
                up[c[a]][c[b]] += w
        level = {a: dict(x) for a, x in up.items()}
    inside = sum(w for a, x in links.items() for b, w in x.items() if home[a] == home[b])
    degrees = collections.defaultdict(float)
    for a, x in links.items():
        degrees[home[a]] += sum(x.values())
    return inside / total - resolution * sum(d * d for d in degrees.values()) / total**2


@pytest.mark.parametrize("seed", [1])
def test_as_good_as_a_sequential_run(spark, seed):
    rng = random.Random(seed)
    rows = [(a, b, rng.randint(1, 3)) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.35 if a % 5 == b % 5 else 0.04)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long")
    got = communities.quality(edges, communities.louvain(edges)).first()
    assert (got.unplaced, got.disconnected, got.gaining) == (0, 0, 0)
    assert got.modularity >= sequential(rows) - 0.01


def test_quality_sees_what_is_wrong(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 5, 1), (5, 6, 1), (6, 4, 1), (3, 4, 1)], "src long, dst long, weight long")
    parts = lambda rows: spark.createDataFrame(rows, "node long, community long")
    bad = communities.quality(edges, parts([(1, 0), (2, 0), (3, 1), (4, 1), (5, 0)])).first()
    assert (bad.nodes, bad.total, bad.unplaced, bad.disconnected) == (6, 7, 1, 1) and bad.gaining > 0
    good = communities.quality(edges, parts([(n, n // 4) for n in range(1, 7)])).first()
    assert tuple(good)[2:5] == (0, 0, 0) and abs(good.modularity - (6 / 7 - 0.5)) < 1e-12
