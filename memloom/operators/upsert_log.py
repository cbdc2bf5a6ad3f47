"""A newest-wins table that is kept by appending: sorted runs of versions, merged in tiers.

A batch is written once, as a run of its own, so what is written follows the batch and not the table. Readers fold the versions of
all runs (``newest_wins``). When a tier has ``FANOUT`` runs they become one of the next tier, in which a version stays only if it can
still decide something: versions may arrive in any order, so that is more than the newest one (``deciding``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from memloom.operators.store import blank, newest_wins
from memloom.operators.versions import Manifest

#: Runs of a tier that are merged into one of the next.
FANOUT = 4
#: Parts that the versions of a key are sorted out in first, so that a key of very many versions is no single task.
SALTS = 16
#: Versions that a task sorts, about, where keys have few of them.
PART_ROWS = 1 << 17


def parts(rows: int, each: int | None = None) -> int:
    """How many parts of about ``each`` rows there are: adaptive execution would put more into a task the more there are."""
    return max(1, -(-rows // (each or PART_ROWS)))


def deciding(versions: DataFrame, key: str = "key", seq: str = "seq", updated: str = "updated_at", force: str | None = None) -> DataFrame:
    """The versions that can still decide what survives, whatever arrives later and wherever in the order.

    Of each key: the first one, whose created_at stays; the last reset; and of what came after it those without a later version of a
    later time. ``newest_wins`` of these and of any others is that of all.
    """
    reset = blank(F.col(updated)) | (F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False))
    time = F.when(~blank(F.col(updated)), F.col(updated))

    def sifted(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col(seq).desc())
        later = order.rowsBetween(Window.unboundedPreceding, -1)
        marked = rows.withColumn("_reset", reset).withColumn("_after", F.coalesce(F.max("_reset").over(later), F.lit(False)))
        marked = marked.withColumn("_best", F.max(time).over(later)).withColumn("_first", F.lead(F.lit(1)).over(order).isNull())
        better = F.coalesce(F.col("_best") > time, F.lit(False))
        return marked.filter(F.col("_first") | ~F.col("_after") & (F.col("_reset") | ~better)).drop("_reset", "_after", "_best", "_first")

    salted = versions.withColumn("_salt", F.pmod(F.xxhash64(seq), F.lit(SALTS)))
    return sifted(sifted(salted, key, "_salt").drop("_salt"), key)


class UpsertLog:
    """Versions of rows by key under ``path``; ``force`` names a column that makes a version replace whatever is there.

    With ``few`` versions of each key they are dealt out by key in parts of about ``PART_ROWS``, so that tasks do not grow.
    """

    def __init__(self, spark: SparkSession, path: str, force: str | None = None, few: bool = False) -> None:
        self.spark, self.path, self.force, self.few = spark, path.rstrip("/"), force, few
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def append(self, batch: DataFrame, stream: str = "", number: int | None = None) -> bool:
        """Add a batch of versions (key, seq, updated_at, created_at, ...); False if this ``number`` of the ``stream`` was there.

        The run is in the table once its manifest is: a batch that fails on the way, or is run again, counts once.
        """
        version, now = self.manifest.read()
        done = now.get("done", {})
        if number is not None and number <= done.get(stream, -1):
            return False
        run = self._write(batch, 0, batch.count() if self.few else None)
        kind = now.get("schema") or batch.schema.jsonValue()
        done = done | ({stream: number} if number is not None else {})
        self.manifest.write(version + 1, {"schema": kind, "done": done, "runs": [*now.get("runs", []), *([run] if run else [])]})
        self.compact()
        self.manifest.prune()
        return True

    def _write(self, rows: DataFrame, tier: int, about: int | None) -> dict | None:
        """Write a run of ``about`` so many rows, if that is known."""
        name = uuid.uuid4().hex[:12]
        # sorted by key, with a Bloom filter of the keys: a lookup leaves out most row groups
        out = rows.repartitionByRange(*([] if about is None else [parts(about)]), F.col("key"), F.col("seq"))
        out.sortWithinPartitions("key", "seq").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/runs/{name}")
        n, low, high = self.spark.read.schema(rows.schema).parquet(f"{self.path}/runs/{name}").agg(F.count("*"), F.min("key"), F.max("key")).first()
        return {"name": name, "tier": tier, "rows": n, "low": low, "high": high} if n else None

    def compact(self) -> int:
        """Merge full tiers; the number of merges. Runs that are replaced stay for readers until ``vacuum``."""
        merges = 0
        while True:
            version, now = self.manifest.read()
            runs = now.get("runs", [])
            tier = next((t for t in sorted({r["tier"] for r in runs}) if sum(r["tier"] == t for r in runs) >= FANOUT), None)
            if tier is None:
                return merges
            old = [r for r in runs if r["tier"] == tier]
            about = sum(r["rows"] for r in old) if self.few else None
            merged = self._write(deciding(self._dealt(now, old), force=self.force), tier + 1, about)
            self.manifest.write(version + 1, now | {"runs": [r for r in runs if r["tier"] != tier] + [merged]})
            merges += 1

    def _versions(self, now: dict, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(now["schema"])).parquet(*[f"{self.path}/runs/{r['name']}" for r in runs])

    def _dealt(self, now: dict, runs: list[dict]) -> DataFrame:
        rows = self._versions(now, runs)
        return rows.repartition(parts(sum(r["rows"] for r in runs)), "key") if self.few else rows

    def table(self, keys: DataFrame | None = None, join: str | None = None) -> DataFrame | None:
        """The newest version of each key, or of those in ``keys(key)``; None before the first batch with rows. ``join`` as in ``newest_wins``."""
        _, now = self.manifest.read()
        if not now.get("runs"):
            return None
        rows = self._dealt(now, now["runs"])
        return newest_wins(rows if keys is None else rows.join(keys, "key", "left_semi"), force=self.force, join=join)

    def lookup(self, keys: list[str]) -> DataFrame | None:
        """The newest versions of some keys: only runs whose range has one of them are opened."""
        _, now = self.manifest.read()
        runs = [r for r in now.get("runs", []) if any(r["low"] is not None and r["low"] <= k <= r["high"] for k in keys)]
        if not runs:
            return self.table().limit(0) if now.get("runs") else None
        return newest_wins(self._versions(now, runs).filter(F.col("key").isin(*keys)), force=self.force)

    def vacuum(self) -> int:
        """Delete runs that the current version does not name; their number."""
        live = {r["name"] for r in self.manifest.read()[1].get("runs", [])}
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = fs_path(f"{self.path}/runs")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in live] if fs.exists(root) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

