"""Shared plumbing: tables in the shared folder, Arrow loops and deterministic row numbers."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Session, path and driver thread of each table that is there: runs side by side know their own.
_written: list[tuple[SparkSession, str, int]] = []
#: Folders of local applications that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    A local session without that setting (tests) gets a temporary folder; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting cannot be changed in a running session
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="memloom-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of this session's own in the shared folder, which ``forget`` deletes."""
    path = f"{shared_dir(spark)}/memloom-{uuid.uuid4().hex}-{label}"
    _written.append((spark, path, threading.get_ident()))
    return path


def written(spark: SparkSession) -> set[str]:
    """Tables that this thread wrote with ``materialize`` in this session and that are still there."""
    return {path for owner, path, thread in _written if owner is spark and thread == threading.get_ident()}


def forget(spark: SparkSession, only: set[str] | None = None) -> None:
    """Delete what ``materialize`` wrote in this session, or some of it; results that still read it become invalid."""
    jvm = spark.sparkContext._jvm
    for entry in [x for x in _written if x[0] is spark and (only is None or x[1] in only)]:
        at = jvm.org.apache.hadoop.fs.Path(entry[1])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(entry)


@atexit.register
def _forget_all() -> None:
    for spark in {id(x[0]): x[0] for x in _written}.values():
        try:
            forget(spark)
        except Exception:  # noqa: BLE001  the session is gone and so is its file system handle
            return


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones, so that Python objects of few texts exist at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 256, keep: Sequence[str] = ()) -> DataFrame:
    """Arrow map whose ``make()`` runs once a task and returns a function from a short batch to columns.

    The result has the ``keep`` columns of ``df``, with their types, and then those of ``schema``.
    """
    kind = StructType([*[df.schema[k] for k in keep], *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches, rows):
            made = {k: part.column(k) for k in keep} | step(part)
            # columns that pass through keep their Arrow type
            arrays = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, arrow.names)

    return df.mapInArrow(run, kind)


def packed(docs: DataFrame, *need: str) -> DataFrame:
    """``need`` columns of ``docs`` and all others in one struct ``_row``, so that no name can clash with an operator's own."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in need]
    return docs.select(*[docs[f"`{c}`"] for c in need], (F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))).alias("_row"))


def unpacked(rows: DataFrame, columns: list[str], *need: str) -> list[Column]:
    """The columns of a table that ``packed`` closed, in their order."""
    return [F.col(c) if c in need else F.col("_row").getField(c).alias(c) for c in columns]


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... in the given order, by a distributed sort and per-partition offsets.

    Only the offsets, one row for each partition, meet in one task.
    """
    stable = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = stable.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return (
        stable.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_before")
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
