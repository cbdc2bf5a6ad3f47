import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from memloom.llm import negatives as x


def vectors(spark, seed=1, n=700, width=6, clusters=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    rows = []
    for i in range(n):
        v = centres[i % clusters] + rng.normal(size=width) * (0.2 if i % 3 else 0.0)
        rows.append((i, [float(c) for c in v * (1 + i % 5)], int(rng.integers(0, 4)), "t"))
    rows += [(n, None, 1, "t"), (n + 50, [1.0] * width, None, "t"), (n + 1, [float("nan")] * width, 1, "t"), (n + 2, [1.0, None] * (width // 2), 1, "t"), (n + 3, [float("inf")] * width, 2, "t")]
    rows += [(2000 + i, [0.0] * width, 3, "t") for i in range(60)] + [(5000, [-3.0] * width, 9, "t")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long, cell string")


@pytest.mark.parametrize(("seed", "width", "clusters"), [(1, 6, 4), (2, 24, 1)])
def test_against_sql(spark, tmp_path, monkeypatch, seed, width, clusters):
    for name, value in (("CELL_ROWS", 60), ("BLOCK_ROWS", 40), ("LEAF_ROWS", 8), ("ANCHORS", 4)):
        monkeypatch.setattr(x, name, value)
    table = vectors(spark, seed, width=width, clusters=clusters)
    pq.write_table(table.toArrow(), tmp_path / "v.parquet")
    want = duckdb.sql(x.ORACLE.format(vectors=f"'{tmp_path}/v.parquet'"))
    got = x.mine(table)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_bounds_hold_and_cells_are_left_out():
    """Every score lies between a leaf's bounds, and in few dimensions most leaves are out of reach."""
    rng = np.random.default_rng(0)
    data, q = np.floor(rng.normal(size=(2000, 3)) * 256), np.floor(rng.normal(size=(50, 3)) * 256)
    longest = float((data * data).sum(1).max())
    aug = x.augmented(data, longest)
    tree = x.Tree(aug[:500], longest, 32)
    far, size = tree.distances(aug), (q * q).sum(1)
    leaf, away = tree.leaf(far), tree.anchor_distances(q)
    scores, needless = q @ data.T, 0
    best = scores.max(1)
    for i, path in enumerate(tree.paths):
        m = np.flatnonzero(leaf == i)
        if len(m):
            least, most = x.reach(away, far[m][:, path].min(0), far[m][:, path].max(0), path, size, longest)
            assert (least[:, None] <= scores[:, m]).all() and (scores[:, m] <= most[:, None]).all()
            needless += (most < best).sum()
    assert len(np.unique(leaf)) > 16 and needless > 25 * len(tree.paths)


def test_ties_go_to_the_smaller_id():
    ids, labels = np.array([9, 3, 5, 7]), np.array([1, 1, 1, 2])
    data = np.ones((4, 2))
    open_ = np.full((1, 1), np.inf)
    who, best = x.best_in_block(ids, labels, data, 2.0, np.array([3]), np.array([1]), np.ones((1, 2)), -open_, open_, True, 3)
    assert who[0, 0].tolist()[:2] == [5, 9] and best[0, 0].tolist() == [2, 2, -np.inf]


def test_odd_tables(spark):
    table = vectors(spark)
    assert x.mine(table.limit(0)).collect() == []
    assert x.mine(table.filter("vec_id = 50")).collect() == []
    twice = spark.createDataFrame([(50, [1.0], 1), (50, [1.0], 1), (51, [1.0, 2.0], 1), (52, [0.7], 2), (None, [1.0], 1), (53, [], 3)], "vec_id long, embedding array<float>, label long")
    assert [tuple(r) for r in x.mine(twice).collect()] == [(50, 51, 1, 52, 256 * 256, 256 * 179)]
