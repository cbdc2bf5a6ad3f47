"""Communities: modularity optimisation by rounds of DataFrame moves, contraction, and themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.operators.tables import Scratch


def _undirected(edges: DataFrame) -> DataFrame:
    """Parallel edges summed, both directions as rows; a loop is one row of twice its weight."""
    one = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").cast("double").alias("w"))
    loops = one.filter("a = b").select("a", "b", (2 * F.col("w")).alias("w"))
    both = one.filter("a <> b")
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).unionByName(loops)


def modularity(links: DataFrame, parts: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of parts(node, c) over symmetric links(a, b, w)."""
    rows = links.join(parts.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    each = rows.groupBy("ca").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    total, inside, square = each.agg(F.sum("d"), F.sum("inside"), F.sum(F.col("d") * F.col("d"))).first()
    return inside / total - resolution * square / (total * total) if total else 0.0


def _best_moves(links: DataFrame, parts: DataFrame, total: float, resolution: float) -> DataFrame:
    """a, own, best, gain: for each node its community, the neighbouring one of greatest gain (least id on ties), and what moving
    there gains in modularity; staying gains nothing."""
    degree = links.groupBy("a").agg(F.sum("w").alias("k"))
    sums = degree.join(parts.withColumnRenamed("node", "a"), "a").groupBy("c").agg(F.sum("k").alias("tot"))
    near = links.filter("a <> b").join(parts.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").groupBy("a", F.col("cb").alias("c")).agg(F.sum("w").alias("to"))
    own = parts.select(F.col("node").alias("a"), F.col("c").alias("own"))
    here = own.select("a", F.col("own").alias("c"), F.lit(0.0).alias("to"))
    rows = near.unionByName(here).groupBy("a", "c").agg(F.sum("to").alias("to")).join(own, "a").join(degree, "a").join(sums, "c")
    rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
    worth = F.col("to") - F.lit(resolution) * F.col("k") * rest / F.lit(total)
    # a move has to gain more than rounding does; staying wins ties
    rows = rows.withColumn("worth", F.round(worth, 9))
    best = rows.groupBy("a", "own").agg(F.min(F.struct((-F.col("worth")).alias("g"), (F.col("c") != F.col("own")).alias("m"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("worth"))).alias("stay"))
    return best.select("a", "own", F.col("best.c").alias("best"), (2 * (-F.col("best.g") - F.col("stay")) / F.lit(total)).alias("gain"))


def _moved(moves: DataFrame, chosen: DataFrame) -> DataFrame:
    """Parts after the ``chosen`` (a) of the ``moves``."""
    turn = chosen.select("a").withColumn("_go", F.lit(True))
    return moves.join(turn, "a", "left").select(F.col("a").alias("node"), F.when(F.col("_go"), F.col("best")).otherwise(F.col("own")).alias("c"))


def _apart(moves: DataFrame) -> DataFrame:
    """Gaining moves of which no two leave or enter the same community: their gains add up, so together they gain for sure.

    A move is one if it is the greatest at both of its communities (ties by a hash of the node, then its id).
    """
    rank = F.struct("gain", F.xxhash64("a").alias("h"), "a")
    going = moves.filter("best <> own and gain > 0").withColumn("rank", rank)
    ends = going.select("a", "rank", F.explode(F.array("own", "best")).alias("c"))
    top = ends.groupBy("c").agg(F.max("rank").alias("top"))
    return ends.join(top, "c").filter(F.col("rank") == F.col("top")).groupBy("a").agg(F.count("*").alias("n")).filter("n = 2")


def _local_optimum(scratch: Scratch, links: DataFrame, parts: DataFrame, total: float, resolution: float, min_gain: float) -> tuple[DataFrame, float]:
    """Parts from which no move of one node gains ``min_gain``, and their modularity; every round gains.

    A round moves half of the nodes (by hash) at once, each to its best community, and all of them once they are few. If that loses, for
    nodes that moved together spoil each other's gain, it moves those that cannot (``_apart``) instead.
    """
    best, turn, few = modularity(links, parts, resolution), 0, parts.count() // 5
    while True:
        moves = scratch.stored(_best_moves(links, parts, total, resolution), "moves")
        going = moves.filter((F.col("best") != F.col("own")) & (F.col("gain") > min_gain))
        n = going.count()
        if not n:
            return parts, best
        half = going.filter(F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0)
        moved = scratch.stored(_moved(moves, going if n <= few else half), "moved")
        now = modularity(links, moved, resolution)
        turn += 1
        if now <= best + min_gain:
            moved = scratch.stored(_moved(moves, _apart(moves)), "moved")
            now = modularity(links, moved, resolution)
        parts, best = moved, now


def connected(scratch: Scratch, links: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts with each community cut into its connected pieces, named by their least node: that loses no link, so it gains.

    Least names travel along links inside a community; each round a node also takes the name that its name has, so rounds follow the
    logarithm of a piece's width and not the width.
    """
    side = lambda name: parts.select(F.col("node").alias(name), F.col("c").alias(f"c{name}"))
    inner = scratch.stored(links.filter("a <> b").join(side("a"), "a").join(side("b"), "b").filter("ca = cb").select("a", "b"), "inner")
    named = scratch.stored(parts.select("node", F.col("node").alias("c")), "named")
    while True:
        heard = inner.join(named.select(F.col("node").alias("b"), F.col("c").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        new = named.join(heard, "node", "left").select("node", F.least("c", F.coalesce("other", "c")).alias("c"))
        up = new.select(F.col("node").alias("c"), F.col("c").alias("up"))
        new = scratch.stored(new.join(up, "c", "left").select("node", F.coalesce("up", "c").alias("c")), "named")
        if new.exceptAll(named).isEmpty():
            return new
        named = new


def louvain(edges: DataFrame, resolution: float = 1.0, min_gain: float = 1e-6) -> DataFrame:
    """(node, community) by rounds of moves and contraction; the same edges give the same communities.

    Levels end when one gains less than ``min_gain``. Then nodes move once more, from the communities that were found, and those
    that fell apart are cut: at the end each community is connected and no move of one node gains ``min_gain``. Every round gains,
    and modularity is at most one, so all of it ends by itself. Each round is a table in the shared folder; they go at the end.
    ``edges(src, dst, weight)``; no edges: no rows.
    """
    scratch = Scratch(edges.sparkSession)
    base = links = scratch.stored(_undirected(edges), "links")
    total = links.agg(F.sum("w")).first()[0]
    own = lambda df: df.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("c"))
    result = scratch.stored(own(links), "parts")
    while total:
        parts = scratch.stored(own(links), "parts")
        begin = modularity(links, parts, resolution)
        parts, best = _local_optimum(scratch, links, parts, total, resolution, min_gain)
        if best <= begin + min_gain:
            break
        result = scratch.stored(result.join(parts.select(F.col("node").alias("c"), F.col("c").alias("up")), "c").select("node", F.col("up").alias("c")), "result")
        up = lambda side: parts.select(F.col("node").alias(side), F.col("c").alias(f"c_{side}"))  # noqa: B023, E731
        links = scratch.stored(links.join(up("a"), "a").join(up("b"), "b").groupBy(F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.sum("w").alias("w")), "links")
    while total:
        before = modularity(base, result, resolution)
        whole = connected(scratch, base, result)
        result, now = _local_optimum(scratch, base, whole, total, resolution, min_gain)
        if now <= before + min_gain and connected(scratch, base, result).select("c").distinct().count() == result.select("c").distinct().count():
            break
    scratch.drop(result)
    return result.select("node", F.col("c").alias("community"))


def quality(edges: DataFrame, communities: DataFrame, resolution: float = 1.0, min_gain: float = 1e-6) -> DataFrame:
    """One row on ``communities(node, community)`` over edges: nodes, total (weight of the edges), unplaced nodes, disconnected
    communities, nodes whose move would gain ``min_gain``, and the modularity."""
    scratch = Scratch(edges.sparkSession)
    links = scratch.stored(_undirected(edges), "links")
    parts = scratch.stored(communities.select("node", F.col("community").alias("c")), "parts")
    total = links.agg(F.sum("w")).first()[0] or 0.0
    nodes = links.select(F.col("a").alias("node")).distinct()
    unplaced = nodes.join(parts, "node", "left_anti").count() + parts.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").count()
    pieces = connected(scratch, links, parts).select("c").distinct().count() - parts.select("c").distinct().count()
    gaining = _best_moves(links, parts, total, resolution).filter((F.col("best") != F.col("own")) & (F.col("gain") > min_gain)).count() if total else 0
    row = (nodes.count(), int(total / 2), unplaced, pieces, gaining, modularity(links, parts, resolution))
    scratch.drop()
    return edges.sparkSession.createDataFrame([row], "nodes long, total long, unplaced long, disconnected long, gaining long, modularity double")


def store_communities(communities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(communities, members) from ``communities(seq, community_id, label, entity_ids)``: a size counts the listed ids, an entity
    that several list belongs to the last."""
    rows = communities.select("community_id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce(F.size("entity_ids"), F.lit(0)).alias("size"))
    listed = communities.select("seq", "community_id", F.explode("entity_ids").alias("entity_id"))
    return rows, listed.groupBy("entity_id").agg(F.max_by("community_id", "seq").alias("community_id"))


def rename(communities: DataFrame, names: DataFrame) -> DataFrame:
    """Communities under the last of their new labels: ``names(community_id, seq, label)``."""
    last = names.groupBy("community_id").agg(F.max_by(F.coalesce("label", F.lit("")), "seq").alias("_label"))
    return communities.join(last, "community_id", "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def themes(parts: DataFrame, entities: DataFrame, min_size: int = 3, top: int = 4) -> tuple[DataFrame, DataFrame]:
    """(communities, members): communities of ``min_size`` and more by falling size, labelled by their most mentioned members.

    A community's id is that of its detection, so ids stay while others come and go; ``members(entity_id, community_id)``.
    """
    rows = parts.select(F.col("node").alias("entity_id"), "community").join(entities, "entity_id")
    sizes = rows.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.col("mentions").desc(), "entity_id")))
    label = ranked.filter(F.col("r") <= top).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "canonical"))), lambda x: x["canonical"]), " / ").alias("label"))
    named = sizes.join(label, "community").withColumn("community_id", F.col("community"))
    members = rows.join(named.select("community", "community_id"), "community").select("entity_id", "community_id")
    return named.select("community_id", "label", "size"), members


def theme_members(members: DataFrame, entities: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` most mentioned members of each community: community_id, rank, canonical."""
    w = Window.partitionBy("community_id").orderBy(F.col("mentions").desc(), "entity_id")
    rows = members.join(entities, "entity_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return rows.select("community_id", "rank", "canonical")
