"""Co-occurrence edges that are kept up to date: chunks that are submitted again change the pairs that they have, or had.

Three tables: ``chunks`` has what each chunk says, ``shares`` a row for each pair and chunk, ``edges`` the sums. A submit takes the
shares of its chunks out, puts their new ones in, and sums up again those pairs only. All three are logs of versions, so what is
written follows the submit; a pair or chunk that is gone is a version without content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.edges import CHUNK, PAIR, chunk_entities, chunk_pairs, evidence_of, first_said, summed
from memloom.operators.tables import Scratch, exists
from memloom.operators.upsert_log import UpsertLog, parts

#: Entities up to which the affected pairs' sources stand in the plan as literals, which the Parquet reader can use.
LISTED = 500


class EdgeView:
    """Edges under ``path``, as ``edges.edges`` makes them of all mentions and assertions that were submitted."""

    def __init__(self, spark: SparkSession, path: str, evidence_per_chunk: int = 3, evidence_cap: int = 20) -> None:
        self.spark, self.path, self.per_chunk, self.cap = spark, path.rstrip("/"), evidence_per_chunk, evidence_cap
        self.chunks, self.shares, self.edges = (UpsertLog(spark, f"{self.path}/{name}", few=True) for name in ("chunks", "shares", "edges"))

    def submit(self, number: int, touched: DataFrame, mapped: DataFrame, assertions: DataFrame) -> None:
        """Replace the ``touched`` chunks (conv_key, chunk_idx) by what ``mapped`` and ``assertions`` have of them.

        A chunk with nothing in them is purged: deleted, or of an owner who is now excluded. ``number`` counts submits up from 0; one
        that was killed is repeated under its number and goes on with what it had staged. Chunks have ids of one type.
        """
        staged = {name: f"{self.path}/staged/{number}/{name}" for name in ("shares", "edges", "chunks")}
        if not exists(self.spark, f"{self.path}/staged/{number}/chunks/_SUCCESS"):
            self._stage(number, touched.select(*CHUNK), mapped, assertions, staged)
        # the chunks come last: until they are stored the shares to take out can be told again
        for name, log in (("shares", self.shares), ("edges", self.edges), ("chunks", self.chunks)):
            log.append(self.spark.read.parquet(staged[name]), "submit", number)

    def _stage(self, number: int, touched: DataFrame, mapped: DataFrame, assertions: DataFrame, staged: dict[str, str]) -> None:
        stamp = [F.lit(number).cast("long").alias("seq"), F.lit(f"{number:012d}").alias("updated_at"), F.lit(f"{number:012d}").alias("created_at")]
        chunk_key, share_key = F.concat_ws(":", *CHUNK), F.concat_ws(":", *PAIR, *CHUNK)
        # what a submit has of chunks is dealt out by chunk, the shares by their keys, in parts of bounded rows; each step is a table, as
        # a task has a page at least for everything that it sorts or sums up
        n = parts(max(df.count() for df in (touched, mapped, assertions)))
        scratch = Scratch(self.spark)
        deal = lambda df: df.repartition(n, *CHUNK)
        touched = scratch.stored(deal(touched).distinct(), "touched")
        pick = lambda df: deal(df).join(deal(touched), list(CHUNK), "left_semi")
        typed = pick(assertions).groupBy(*CHUNK, F.coalesce("type", F.lit("related")).alias("type")).agg(F.count("*").alias("n"))
        said = scratch.stored(typed.groupBy(*CHUNK).agg(F.collect_list(F.struct("type", "n")).alias("types")), "types")
        first = scratch.stored(first_said(pick(assertions), self.per_chunk).withColumnRenamed("ids", "said"), "said")
        new = deal(scratch.stored(chunk_entities(pick(mapped)), "entities")).join(deal(said), list(CHUNK)).join(deal(first), list(CHUNK))
        now = deal(touched).join(new, list(CHUNK), "left").select(*CHUNK, "ids", "day", "types", "said")
        now.select(chunk_key.alias("key"), *stamp, *CHUNK, "ids", "day", "types", "said").write.mode("overwrite").parquet(staged["chunks"] + ".new")
        now = self.spark.read.parquet(staged["chunks"] + ".new")
        scratch.drop()
        put = chunk_pairs(now.filter("ids is not null"), "types", "said").withColumn("gone", F.lit(False))
        old = self.chunks.table(now.select("key"))
        if old is not None:
            # a pair is lost if one of its ends is no longer in the chunk
            had = chunk_pairs(old.filter("ids is not null").join(now.select("key", F.col("ids").alias("_new")), "key"), "types", "said", "_new")
            stays = F.array_contains("_new", F.col("src")) & F.array_contains("_new", F.col("dst"))
            put = put.unionByName(had.filter(~F.coalesce(stays, F.lit(False))).drop("_new").withColumn("gone", F.lit(True)))
        put.select(share_key.alias("key"), *stamp, *PAIR, *CHUNK, "day", "types", F.col("said").alias("ids"), "gone").write.mode("overwrite").parquet(staged["shares"])
        changed = self.spark.read.parquet(staged["shares"])
        changed = changed.repartition(parts(changed.count()), "key")
        # the pairs to sum up again, with all their shares: those that stand and are not replaced, and the new ones
        pairs = changed.select(*PAIR).distinct()
        rows = changed.filter("not gone")
        known = self.shares.table()
        if known is not None:
            few = [r.src for r in pairs.select("src").distinct().limit(LISTED + 1).collect()]
            mine = known.filter(F.col("src").isin(few)) if len(few) <= LISTED else known
            stand = mine.filter("not gone").join(changed.select("key"), "key", "left_anti").join(pairs, list(PAIR), "left_semi")
            rows = rows.unionByName(stand.select(*rows.columns))
        total = summed(rows).join(evidence_of(rows, None, self.cap), list(PAIR))
        out = pairs.join(total, list(PAIR), "left").withColumn("gone", F.col("weight").isNull())
        out.select(F.concat_ws(":", *PAIR).alias("key"), *stamp, *PAIR, "weight", "relation", "evidence", "first_seen", "last_seen", "gone").write.mode("overwrite").parquet(staged["edges"])
        now.write.mode("overwrite").parquet(staged["chunks"])

    def table(self) -> DataFrame | None:
        """The edges as they stand: src, dst, weight, relation, evidence, first_seen, last_seen."""
        rows = self.edges.table()
        return rows.filter("not gone").select(*PAIR, "weight", "relation", "evidence", "first_seen", "last_seen") if rows is not None else None
