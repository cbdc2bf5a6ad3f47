"""Hard negatives from a vantage-point tree over norm-augmented vectors.

One more component makes all vectors equally long, so inner products become angles on a sphere: a greater score is a smaller
distance, and a window of scores is an annulus around the anchor. A tree over a bounded sample deals all rows into cells whose distances to
the vantage points above them are bounded; a cell's rows are cut into blocks, and each block has a small tree of its own. An
anchor visits cells from the nearest on: first a few, then those that can still hold one of its k best inside the annulus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices

#: About how many rows, and values in them, the tree's vantage points and radii are taken from, and cells at most: these bound what
#: the driver and tasks hold. Rows are chosen by a hash of their id.
TREE_SAMPLE, SAMPLE_VALUES, MOST_CELLS = 8192, 1 << 19, 1024
#: Rows of a cell that the number of cells aims at, of a block, and of a leaf of a block's own tree.
CELL_ROWS, BLOCK_ROWS, LEAF_ROWS = 4096, 4096, 512
#: Cells that an anchor visits before it knows how far it has to go, and anchors that one task searches for at a time.
FIRST_CELLS, ANCHORS = 2, 512


class Tree:
    """A vantage-point tree over the rows of a matrix: inner nodes split at the median distance, leaves are numbered from the left."""

    def __init__(self, points: np.ndarray, longest: float, leaves: int) -> None:
        self.longest = max(longest, 1e-300)
        self.points, self.radii, self.kids = [], [], []
        self.paths: list[list[int]] = []
        self.root = self._grow(points, leaves, [])
        self.vantage = np.array(self.points).reshape(-1, points.shape[1])

    def _grow(self, points: np.ndarray, leaves: int, path: list[int]) -> int:
        far = np.zeros(0)
        if leaves > 1 and len(points) > 1:
            # the point that is farthest from the first one splits better than one in the middle
            at = points[np.argmax(self._angles(points, points[:1]))]
            far = self._angles(points, at[None])[:, 0]
        if not len(far) or far.min() == far.max():
            self.paths.append(path)
            return -len(self.paths)
        node = len(self.points)
        radius = float(np.median(far))
        radius = radius if (far > radius).any() else float(np.nextafter(far.max(), 0))
        self.points.append(at)
        self.radii.append(radius)
        self.kids.append((0, 0))
        near = self._grow(points[far <= radius], leaves // 2, [*path, node])
        self.kids[node] = (near, self._grow(points[far > radius], leaves - leaves // 2, [*path, node]))
        return node

    def _angles(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ to.T / self.longest, -1, 1))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Angles between augmented rows and all vantage points."""
        return self._angles(x, self.vantage) if len(self.vantage) else np.zeros((len(x), 0))

    def anchor_distances(self, q: np.ndarray) -> np.ndarray:
        """Angles between anchors and all vantage points: an anchor is made as long as the longest row, and has no further component."""
        size = np.sqrt((q * q).sum(1))
        grown = q * (np.sqrt(self.longest) / np.maximum(size, 1e-150))[:, None]
        return self.distances(np.hstack([grown, np.zeros((len(q), 1))]))

    def leaf(self, far: np.ndarray) -> np.ndarray:
        """The leaf of each row, from its ``distances``."""
        at = np.full(len(far), self.root)
        kids, radii = np.array(self.kids).reshape(-1, 2), np.array(self.radii)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = kids[node, (far[inner, node] > radii[node]).astype(int)]
        return -at - 1


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component that makes each as long as the longest (squared length)."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]])


def reach(far: np.ndarray, low: np.ndarray, high: np.ndarray, path: list[int], size: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that rows of a leaf can have with each anchor, by the triangle inequality.

    ``far``: the anchors' distances to all vantage points; ``low`` and ``high``: least and greatest distance of the leaf's rows to those
    of ``path``. One unit of score, and a millionth of the greatest, is left for rounding.
    """
    edge = np.sqrt(size * longest)
    slack = 1 + 1e-6 * edge
    if not path:
        return -edge - slack, edge + slack
    d = far[:, path]
    near = np.maximum(0, np.maximum(d - high, low - d)).max(1)
    away = np.minimum(np.pi, np.minimum(d + high, 2 * np.pi - d - low)).min(1)
    return edge * np.cos(away) - slack, edge * np.cos(near) + slack


def best_in_block(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, longest: float, anchor: np.ndarray, anchor_label: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best rows of a block for every anchor and each of its windows: ids and scores, (anchors, windows, k); minus infinity for none.

    ``low`` and ``high`` (anchors, windows) bound the scores. ``same``: rows of the anchor's label but itself, else those of another.
    An anchor goes through the leaves of the block's tree from the nearest on, while a leaf can hold something better than what it has.
    """
    aug = augmented(x, longest)
    tree = Tree(aug, longest, max(1, -(-len(x) // LEAF_ROWS)))
    far = tree.distances(aug)
    leaf = tree.leaf(far)
    members = [np.flatnonzero(leaf == i) for i in range(len(tree.paths))]
    members = [m[np.argsort(ids[m], kind="stable")] for m in members]
    size = (q * q).sum(1)
    away = tree.anchor_distances(q)
    bounds = [reach(away, far[m][:, p].min(0), far[m][:, p].max(0), p, size, longest) if len(m) else (size * 0 + np.inf, size * 0 - np.inf) for m, p in zip(members, tree.paths, strict=True)]
    least, most = np.array([b[0] for b in bounds]).T, np.array([b[1] for b in bounds]).T
    order = np.argsort(-most, axis=1, kind="stable")
    n, w = low.shape
    best, who = np.full((n, w, k), -np.inf), np.zeros((n, w, k), np.int64)
    for turn in range(len(members)):
        for i in np.unique(order[:, turn]):
            m = members[i]
            # equal scores count: a smaller id may win
            can = (most[:, i, None] >= np.maximum(low, best[:, :, -1])) & (least[:, i, None] <= high)
            here = np.flatnonzero((order[:, turn] == i) & can.any(1))
            if not len(here) or not len(m):
                continue
            scores = q[here] @ x[m].T
            mine = labels[m][None] == anchor_label[here][:, None]
            scores[~mine | (ids[m][None] == anchor[here][:, None]) if same else mine] = -np.inf
            for j in range(w):
                s, at = np.where(scores > high[here, j, None], -np.inf, scores), np.arange(len(here))
                picked = []
                for _ in range(k):  # the first of equal scores has the least id
                    c = s.argmax(1)
                    picked.append((s[at, c], ids[m][c]))
                    s[at, c] = -np.inf
                new = np.array([v for v, _ in picked]).T
                both = np.concatenate([best[here, j], np.where(new < low[here, j, None], -np.inf, new)], axis=1)
                names = np.concatenate([who[here, j], np.array([v for _, v in picked]).T], axis=1)
                kept = np.lexsort((names, -both), axis=1)[:, :k]
                best[here, j], who[here, j] = np.take_along_axis(both, kept, 1), np.take_along_axis(names, kept, 1)
    return who, best


# Spark jobs ----------------------------------------------------------------------------------------------------


def prepared(vectors: DataFrame, relabel: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """vec_id, label, x (array<double> of whole numbers) of the rows that take part, one for each vec_id."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x")


def matrix(column: pa.ChunkedArray | pa.Array, width: int, fill: float = 0.0) -> np.ndarray:
    """Rows of a list column, ``fill`` behind the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    out = np.full((len(sizes), width), fill)
    out[np.arange(width)[None] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def windows(rows: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """The named window columns of anchors as matrices; an anchor with fewer windows has closed ones behind them."""
    most = max(rows.column("low").value_lengths().to_pylist() if isinstance(rows, pa.RecordBatch) else rows["low"].combine_chunks().value_lengths().to_pylist(), default=0)
    return [matrix(rows.column(n), most, -np.inf if n == "high" else np.inf) for n in names]


def dealt(rows: DataFrame, tree: Tree, width: int, longest: float) -> DataFrame:
    """``rows`` with their cell and the distances to the vantage points on its path, from the root."""

    def deal(batches):
        for batch in batches:
            x = augmented(matrix(batch.column("x"), width), longest)
            far = tree.distances(x)
            cell = tree.leaf(far)
            far = [far[i, tree.paths[c]] for i, c in enumerate(cell)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.list_(pa.float64()))], [*batch.schema.names, "cell", "far"])

    return rows.select("vec_id", "label", "x").mapInArrow(deal, "vec_id long, label long, x array<double>, cell int, far array<double>")


class Index:
    """All rows in cells and blocks (a table), the tree, and the bounds of every cell."""

    def __init__(self, rows: DataFrame) -> None:
        rows = materialize(rows, "vectors")
        n, self.width, longest = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()
        self.width, self.longest = self.width or 0, float(longest or 0)
        cells = min(MOST_CELLS, max(1, -(-n // CELL_ROWS)))
        share = min(1.0, min(TREE_SAMPLE, SAMPLE_VALUES / max(1, self.width)) / max(1, n))
        sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("x").toArrow()
        self.tree = Tree(augmented(matrix(sample["x"], self.width), self.longest), self.longest, cells)
        placed = materialize(dealt(rows, self.tree, self.width, self.longest), "cells")
        blocks = F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")
        depth = max(map(len, self.tree.paths))
        sides = [f(F.get("far", F.lit(i))).alias(f"{name}{i}") for i in range(depth) for f, name in ((F.min, "low"), (F.max, "high"))]
        # one row for each cell, of which there are MOST_CELLS at most
        found = {r.cell: r for r in placed.groupBy("cell").agg(blocks, *sides).collect()}
        self.cells = [(c, found[c].blocks, np.array([found[c][f"low{i}"] for i in range(len(p))]), np.array([found[c][f"high{i}"] for i in range(len(p))]), p) for c, p in enumerate(self.tree.paths) if c in found]
        counts = F.create_map(*[F.lit(v) for c in self.cells for v in (c[0], c[1])]) if self.cells else F.create_map(F.lit(0), F.lit(1))
        # a cell of many alike rows is cut into blocks like any other
        self.rows = placed.select("cell", F.pmod(F.xxhash64("vec_id"), F.element_at(counts, F.col("cell"))).cast("int").alias("block"), "vec_id", "label", "x")

    def visits(self, anchors: DataFrame, first: bool) -> DataFrame:
        """``anchors(vec_id, label, x, low, high, kth)`` by cell and block: the nearest cells, or the others that can still matter.

        ``kth`` has, for each window, the score that a row has to reach to be among the k best so far. The nearest cells are those
        with rows inside the annulus: the first round takes ``FIRST_CELLS`` of them, the next one all others but those out of reach.
        """
        tree, cells, width, longest = self.tree, self.cells, self.width, self.longest

        blocks = np.array([c[1] for c in cells], np.int64)

        def visit(batches):
            for batch in slices(batches, ANCHORS):
                q = matrix(batch.column("x"), width)
                size = (q * q).sum(1)
                away = tree.anchor_distances(q)
                low, high, kth = windows(batch, "low", "high", "kth")
                bounds = [reach(away, lo, hi, path, size, longest) for _, _, lo, hi, path in cells]
                least, most = np.array([b[0] for b in bounds]).T, np.array([b[1] for b in bounds]).T
                order = np.argsort(-most, axis=1, kind="stable")
                least, most = np.take_along_axis(least, order, 1)[:, :, None], np.take_along_axis(most, order, 1)[:, :, None]
                inside = ((most >= low[:, None]) & (least <= high[:, None])).any(2)
                turn = inside.cumsum(1)
                if first:
                    chosen = inside & (turn <= FIRST_CELLS)
                else:
                    low = np.maximum(low, kth)
                    chosen = inside & (turn > FIRST_CELLS) & ((most >= low[:, None]) & (least <= high[:, None])).any(2)
                at, place = np.nonzero(chosen)
                where = order[at, place]
                at, where, block = np.repeat(at, blocks[where]), np.repeat(where, blocks[where]), np.concatenate([np.arange(0), *[np.arange(blocks[c]) for c in where]])
                low = pa.array(list(low), pa.list_(pa.float64()))
                high = pa.array(list(high), pa.list_(pa.float64()))
                for begin in range(0, len(at), 4096):
                    i = pa.array(at[begin : begin + 4096])
                    c = np.array([cells[x][0] for x in where[begin : begin + 4096]], np.int32)
                    rows = [batch.column("vec_id").take(i), batch.column("label").take(i), batch.column("x").take(i), low.take(i), high.take(i)]
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(block[begin : begin + 4096].astype(np.int32)), *rows], ["cell", "block", "vec_id", "label", "x", "low", "high"])

        columns = anchors.select("vec_id", "label", "x", "low", "high", "kth")
        return columns.mapInArrow(visit, "cell int, block int, vec_id long, label long, x array<double>, low array<double>, high array<double>")

    def search(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """vec_id, window, other, score: the ``k`` best of each visited block for every window of an anchor."""
        width, longest = self.width, self.longest

        def block(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                ids, labels, x = right["vec_id"].to_numpy(), right["label"].to_numpy(), matrix(right["x"], width)
                for begin in range(0, left.num_rows, ANCHORS):
                    part = left.slice(begin, ANCHORS)
                    low, high = windows(part, "low", "high")
                    anchor = part["vec_id"].to_numpy()
                    who, best = best_in_block(ids, labels, x, longest, anchor, part["label"].to_numpy(), matrix(part["x"], width), low, high, same, k)
                    i, j, r = np.nonzero(~np.isinf(best))
                    out.append(pa.table({"vec_id": anchor[i], "window": pa.array(j, pa.int32()), "other": who[i, j, r], "score": pa.array(best[i, j, r].astype(np.int64))}))
            return pa.concat_tables(out) if out else pa.table({"vec_id": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

        # many anchors of one block are dealt out: each share of them meets a copy of the block
        shares = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / (8 * ANCHORS)).cast("int").alias("shares"))
        rows = self.rows.join(shares, ["cell", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        asked = visits.join(shares, ["cell", "block"]).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int")).drop("shares")
        by = ["cell", "block", "share"]
        return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(block, "vec_id long, window int, other long, score long")

    def nearest(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """The ``k`` best rows for each window of ``anchors(vec_id, label, x, low, high)``: vec_id, window, other, score, rank (from 1)."""
        none = F.transform("low", lambda v: F.lit(float("-inf")))
        start = anchors.withColumn("kth", none)
        found = materialize(self.search(materialize(self.visits(start, True), "visits"), same, k), "first")
        top = _ranked(found, k).filter(F.col("rank") == k).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double")))).alias("reached"))
        # the windows of an anchor whose k best are not there yet stay open
        known = F.transform("low", lambda v, i: F.coalesce(F.element_at("reached", i), F.lit(float("-inf"))))
        rest = anchors.join(top, "vec_id", "left").withColumn("kth", known).drop("reached")
        more = materialize(self.search(materialize(self.visits(rest, False), "visits"), same, k), "more")
        return _ranked(found.unionByName(more), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_id", "window").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, relabel: int = 7) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``; an anchor's positives are the ``positives`` best other rows of its label,
    and for each of them the ``k`` best rows of other labels with a score from ``low`` to ``high`` hundredths of the positive's. Rows whose
    vec_id is divisible by ``relabel`` have the label that follows theirs.
    Higher scores come first, ties by the smaller vec_id. Searches are exact: all cells in reach are visited.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows with one vec_id the one with the
    least label and vector counts. Shorter vectors are filled with zeros. An anchor alone in its label has no positives and no rows; a
    positive score of zero or less has only negatives with a score of zero, or none. No rows: no rows. Other columns are ignored.
    """
    index = Index(prepared(vectors, relabel))
    anchors = index.rows.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "x")
    anyone = [F.array(F.lit(v)).alias(n) for v, n in ((float("-inf"), "low"), (float("inf"), "high"))]
    near = materialize(index.nearest(anchors.select("*", *anyone), True, positives).select("vec_id", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole scores from low * p / 100, rounded up, to high * p / 100, rounded down
    p = F.col("positive_score")
    bounds = [F.ceil(p * low / 100).cast("double").alias("low"), F.floor(p * high / 100).cast("double").alias("high")]
    bounds = near.select("vec_id", F.struct(F.col("rank"), *bounds).alias("w")).groupBy("vec_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    asked = anchors.join(bounds, "vec_id").select("vec_id", "label", "x", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = index.nearest(asked, False, k)
    out = found.join(near.withColumn("window", F.col("rank") - 1).drop("rank"), ["vec_id", "window"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM {vectors} WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
