"""Mixing sources to target weights.

Each row gets a hash-random key; rows are range-sorted by that key within their source, prefix sums of the
token counts are computed in two levels (inside a key range, then over the ranges of a source), and each
source is cut at its exact budget, after whole epochs where the budget exceeds the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, numbered

#: Rows of a source table up to which it is broadcast; beyond, the join is shuffled and AQE splits its skew.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets for ``sources(source, source_size)``: shares by weight, none above ``cap`` times its source.

    Each pass is one aggregate over the sources; what exceeds a cap is shared again by weight until no target does.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = numbered(sources, "_rank", F.col("source").asc_nulls_last()).withColumn("weight", weight.cast("long")).drop("_rank")
    ranked = materialize(ranked, "weighted")
    total, weight_sum, n = ranked.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    held, open_weight = 0, weight_sum or 0
    limit = F.col("source_size") * F.lit(cap)
    for _ in range(n):
        above = F.col("weight").cast("double") * F.lit(float(total - held)) / F.lit(float(max(open_weight, 1))) > limit
        row = ranked.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if ((row[0] or 0), (row[1] or 0)) == (held, open_weight):
            break
        held, open_weight = row[0] or 0, row[1] or 0
    share = F.col("weight").cast("double") * F.lit(float((total or 0) - held)) / F.lit(float(max(open_weight, 1)))
    return ranked.withColumn("target", F.when(share > limit, limit.cast("double")).otherwise(share))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Rows of ``docs`` with the number of words that the mix takes from each.

    Returns doc_id, source, size, source_size, weight, target, epochs, taken. The document at which a source's
    budget ends is taken in part, so a source's ``taken`` sums to the floor of its target.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last in order. The key is a hash of id and
    text, so rows of one id, or without one, spread like others; rows that are equal in both are alike, so reruns agree. Very
    long texts count whole. No rows: no rows. Other columns are ignored.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.md5(F.coalesce("text", F.lit("")))))
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    most = sources.agg(F.max("n"), F.count("*")).first()
    targets = source_targets(sources.drop("n"), weights, cap)
    # 256 ranges at least, and 64k rows in the fullest at most; ranges of a random key have equal shares
    digits = max(2, math.ceil(math.log(max(most[0] or 1, 1) / 65536 + 1e-9, 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_before"))
    if most[1] <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    t = targets.withColumnRenamed("source", "t_source")
    ranges = ranges.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    ranges = ranges.withColumnsRenamed({"source": "r_source", "range": "r_range"})
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    budget = F.floor("target")
    one = F.greatest("source_size", F.lit(1))
    epochs = F.expr("floor(target) div greatest(source_size, 1)")
    left = budget - epochs * one - F.col("range_before") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", "source", "size", "source_size", "weight", "target", epochs.cast("long").alias("epochs"), taken.cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '#' || md5(coalesce(text, ''))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
p AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS all_w,
        coalesce(sum(3 * source_size) OVER r, 0)::BIGINT AS held, coalesce(sum(weight) OVER r, 0)::BIGINT AS held_w
      FROM w WINDOW r AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight::DOUBLE * (total - held)::DOUBLE / (all_w - held_w)::DOUBLE > 3 * source_size AS above FROM p),
f AS (SELECT *, coalesce(sum(CASE WHEN above THEN 3 * source_size END) OVER (), 0)::BIGINT AS c_held,
        coalesce(sum(CASE WHEN NOT above THEN weight END) OVER (), 0)::BIGINT AS open_w FROM c),
t AS (SELECT source, source_size, weight, CASE WHEN above THEN (3 * source_size)::DOUBLE
        ELSE weight::DOUBLE * (total - c_held)::DOUBLE / greatest(open_w, 1)::DOUBLE END AS target FROM f),
x AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.weight, t.target, floor(t.target)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((budget // greatest(source_size, 1)) * size
    + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * greatest(source_size, 1) - before)))::BIGINT AS taken
FROM x
"""
