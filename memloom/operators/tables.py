"""Tables in the shared folder: they cut lineage, and what several branches of a plan read is computed once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_written: list[tuple[SparkSession, str]] = []
#: Folders of local applications that name none.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a local session without one (tests) gets its own, a cluster none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="memloom-")
        _own[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of this session's own in the shared folder; ``forget`` deletes it, at the latest when the process ends."""
    path = f"{shared_root(spark)}/memloom-{uuid.uuid4().hex}-{label}"
    _written.append((spark, path))
    return path


def forget(spark: SparkSession) -> None:
    """Delete the session's tables; results that still read them become invalid."""
    for owner, path in [x for x in _written if x[0] is spark]:
        delete(spark, path)
        _written.remove((owner, path))


@atexit.register
def _forget_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            forget(spark)
        except Exception:  # noqa: BLE001  the session is gone and so is its file system handle
            return


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the given order, by a distributed sort; only one row for each of its parts meets in one task."""
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """Tables of one computation, of which ``drop`` deletes all but the last that a result reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: DataFrame) -> None:
        used = {f for df in keep for f in df.inputFiles()}
        for path in self.paths:
            if not any(path.split("/")[-1] in f for f in used):
                delete(self.spark, path)
        self.paths = []
