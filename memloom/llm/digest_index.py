"""Exact dedup against a persistent digest index.

The index is a Parquet table with one row for each distinct text: the SHA-256 digest of the normalised text, the id that
stays, and the batch that brought it. It is bucketed and sorted by digest, so a batch meets it by a sort-merge anti-join to
which the index is not shuffled; what the index has not got is appended, bucketed in the same way. The layout is on disk:
a later session opens it by its path.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import materialize, new_path, packed, unpacked

SPACE = r"[\x20\x09-\x0D]+"
#: A digest of more rows than this share is hot; no more digests than the share's inverse can be.
HOT_SHARE = 1 / 1000


def normalised(text: Column) -> Column:
    """A text with each run of white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """A table of digests under ``path``: digest binary, keep_id, batch string; bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str) -> None:
        self.spark, self.path, self.buckets, self.id_type = spark, path, buckets, id_type
        self.table = "digests_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        columns = f"digest BINARY, keep_id {id_type}, batch STRING"
        spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/data'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
        """A new index; ``buckets`` is how many tasks a batch meets it in, the session's shuffle partitions by default.

        The number stays with the table. Choose it so that a bucket's digests (about 50 bytes each) fit a task to come.
        """
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(json.dumps({"buckets": buckets, "id_type": id_type}),)], "value string").coalesce(1).write.text(f"{path}/layout")
        return cls(spark, path, buckets, id_type)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        layout = json.loads(spark.read.text(f"{path}/layout").first().value)
        return cls(spark, path, **layout)

    def close(self) -> None:
        """Forget the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def missing(self, groups: DataFrame) -> DataFrame:
        """Of ``groups(digest, ...)``, one row for each digest, those that the index has not got."""
        known = self.rows().select("digest").hint("merge")
        return groups.repartition(self.buckets, "digest").join(known, "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add ``groups(digest, keep_id)`` that the index has not got; a repeated call adds nothing.

        One commit of one job: executors that are lost on the way leave no rows behind.
        """
        # the anti-join reads what the append writes to: its result is a table of its own first
        new = materialize(self.missing(groups).select("digest", F.col("keep_id").cast(self.id_type).alias("keep_id"), F.lit(batch).alias("batch")), "new_digests")
        new.repartition(self.buckets, "digest").write.insertInto(self.table)

    def compacted(self, path: str) -> DigestIndex:
        """A copy at another path with one file for each bucket, for an index of many small batches."""
        out = DigestIndex.create(self.spark, path, self.id_type, self.buckets)
        self.rows().repartition(self.buckets, "digest").write.insertInto(out.table)
        return out


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest and _at of every row of ``docs``, as a table: _at tells rows of one id apart."""
    return materialize(docs.select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("_at")), "digests")


def fill(index: DigestIndex, rows: DataFrame, batch: str) -> DataFrame:
    """Append a batch of ``signatures`` to the index and return its groups: digest, n rows, keep_id, and the _kept row's place.

    Of equal rows in the batch the one with the least id stays, null after all ids, and of rows of one id one; none stays if an
    earlier batch had the text. The same batch, filled in again, gives the same groups: its own digests are known by their batch.
    """
    by = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), "_at")
    groups = materialize(rows.groupBy("digest").agg(F.min(by).alias("first"), F.count("*").alias("n")), "groups")
    index.append(groups.select("digest", F.col("first.id").alias("keep_id")), batch)
    own = (F.col("batch") == batch) & F.col("keep_id").eqNullSafe(F.col("first.id"))
    resolved = groups.repartition(index.buckets, "digest").join(index.rows().hint("merge"), "digest")
    return materialize(resolved.select("digest", "n", "keep_id", F.when(own, F.col("first._at")).alias("_kept")), "resolved")


def placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with keep_id, group_size and kept of ``groups(digest, n, keep_id, _kept)``.

    The groups of hot digests are few by their share of the rows, so rows meet these by broadcast and none fills a task.
    """
    least = max(1000, int(rows.count() * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col("n") > least))
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(groups.filter(F.col("n") <= least), "digest")
    out = rows.join(hot, "digest").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("_kept") == F.col("_at"), F.lit(False))).withColumnRenamed("n", "group_size").drop("_kept")


def report(docs: DataFrame, batches: int = 2, path: str | None = None) -> DataFrame:
    """Every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; the index is filled batch by batch.

    The rows are added in ``batches`` ranges of doc_id, the least first, so the first of equal texts to reach the index has the
    least id (ids that are no numbers make one batch); ``path`` keeps the index. Group sizes are counted over all batches.

    Null and empty texts are one text; a text of white space is one space. Null ids come last; of rows with the same id and
    text one stays, and of rows of one text without an id one. Very long texts count whole. No rows: no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = signatures(docs)
    index = DigestIndex.create(spark, path or new_path(spark, "digest_index"), rows.schema["doc_id"].dataType.simpleString())
    cuts = []
    if isinstance(rows.schema["doc_id"].dataType, NumericType):
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []))
    rank = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    groups = [fill(index, rows.filter(rank == i), str(i)) for i in range(len(cuts) + 1)]
    index.close()
    groups = reduce(DataFrame.unionByName, groups).groupBy("digest").agg(F.sum("n").alias("n"), F.first("keep_id").alias("keep_id"), F.max("_kept").alias("_kept"))
    return placed(rows, materialize(groups, "groups")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of a new batch of ``docs``, all their columns, that are first of their text in the batch and in the index."""
    stable = materialize(packed(docs, "doc_id", "text").withColumn("_at", F.monotonically_increasing_id()), "batch")
    rows = stable.select("doc_id", digest_of(F.col("text")).alias("digest"), "_at")
    left = stable.join(fill(index, rows, batch).select(F.col("_kept").alias("_at")), "_at", "left_semi")
    return left.select(*unpacked(left, docs.columns, "doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM {docs})
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""
