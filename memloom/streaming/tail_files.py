"""Tailing many growing log files as Spark jobs: what was read of each is a table, and a batch has bounded bytes.

``TailJob.poll`` lists the files (in tasks, a folder in one, in file systems that Arrow knows), joins them with the cursors of
earlier batches, takes those that grew up to ``max_bytes``, and lands their new whole lines as a Parquet table. Streams read that
table. Neither the driver nor a checkpoint holds a list of files, and files that do not change cost a row of the listing. Spark's
own file source keeps the status of every file in the driver.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.operators.tables import exists
from memloom.operators.upsert_log import UpsertLog
from memloom.operators.versions import Manifest

LINES = "path string, project string, session string, at long, value string"
FILES = "path string, folder boolean, length long, mtime long"
GROWN = "path string, offset long, length long, mtime long, head string, new long, at long"
PLAN = "path string, first long, stop long, length long, mtime long, head string"
#: Bytes that are looked at in one step, and bytes at a file's beginning that tell it from another.
STEP, HEAD = 1 << 16, 64
#: Files of a listing that leave a task at once.
LISTED_ROWS = 4096


def local_name(path: str) -> str | None:
    """The name of a path of the local file system; None if its scheme is another one."""
    return None if "://" in path else "/" + path.removeprefix("file:").lstrip("/")


def opened(path: str) -> io.BufferedIOBase:
    """A file for reading at any place: of the local file system, or of one that Arrow knows by its scheme."""
    if local := local_name(path):
        return open(local, "rb")
    system, name = arrow_fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(name))


def entries(path: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, whether it is a folder, length, mtime in whole milliseconds as microseconds) of all that is in a folder, as it is read.

    What goes meanwhile is left out, also if it is the folder.
    """
    if local := local_name(path):
        try:
            found = os.scandir(local)
        except FileNotFoundError:
            return
        with found:
            for x in found:
                try:
                    status = x.stat()
                except FileNotFoundError:
                    continue
                name = os.fsencode(x.name).decode("utf-8", "replace")
                yield f"{path}/{name}", x.is_dir(), status.st_size, status.st_mtime_ns // 10**6 * 1000
        return
    system, name = arrow_fs.FileSystem.from_uri(path)
    for x in system.get_file_info(arrow_fs.FileSelector(name, allow_not_found=True)):
        yield f"{path}/{x.base_name}", x.type == arrow_fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 10**6 * 1000


def is_log(path: str, folder: bool, length: int) -> bool:
    """Whether Spark's readers would read it: no folder, not empty, not hidden."""
    name = path.rsplit("/", 1)[-1]
    return not folder and length > 0 and name.endswith(".jsonl") and not name.startswith((".", "_"))


def listed(batches: Iterator[pa.RecordBatch], top: bool) -> Iterator[pa.RecordBatch]:
    """The logs in the folders of ``batches``, at the ``top`` the folders in them too; logs stay as they are."""

    def rows() -> Iterator[tuple[str, bool, int, int]]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["folder"]:
                    yield r["path"], False, r["length"], r["mtime"]
                    continue
                for path, folder, length, mtime in entries(r["path"]):
                    if top and folder or is_log(path, folder, length):
                        yield path, folder, length, mtime

    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    for some in itertools.batched(rows(), LISTED_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some, strict=True), kinds, strict=True)], ["path", "folder", "length", "mtime"])


def head_of(f, n: int) -> str:
    """Digest of the first bytes of a file, of which ``n`` were read before."""
    f.seek(0)
    return hashlib.md5(f.read(min(n, HEAD))).hexdigest()


def stop_of(f, begin: int, wanted: int, length: int) -> int:
    """End of the last whole line of bytes begin..wanted, of the first one behind if none ends there, begin if none ends at all."""
    end = wanted
    while end > begin:
        at = max(begin, end - STEP)
        f.seek(at)
        found = f.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    at = wanted
    while at < length:
        f.seek(at)
        piece = f.read(min(STEP, length - at))
        found = piece.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not piece:
            break
        at += len(piece)
    return begin


def lines_in(f, first: int, begin: int, end: int, stop: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that start in bytes begin..end; those of a batch are whole and end at ``stop``."""
    f.seek(begin)
    if begin > first:  # a line that began before belongs to the piece before
        f.seek(begin - 1)
        begin += len(f.readline()) - 1
    while begin < min(end, stop):
        line = f.readline()
        yield begin, line.rstrip(b"\n").decode("utf-8", "replace")
        begin += len(line)


class TailJob:
    """The new lines of <root>/<project>/<session>.jsonl files, batch by batch, under ``state``: cursors, plans and lines."""

    def __init__(self, spark: SparkSession, root: str, state: str, max_bytes: int = 1 << 30, piece: int = 64 << 20) -> None:
        self.spark, self.root, self.state, self.max_bytes, self.piece = spark, root.rstrip("/"), state.rstrip("/"), max_bytes, piece
        self.cursors = UpsertLog(spark, f"{self.state}/cursors")
        self.manifest = Manifest(spark, f"{self.state}/manifest")
        self.lines = f"{self.state}/lines"

    def listing(self) -> DataFrame:
        """path, length and mtime of every log file; no content is read, and the driver gets no list of them."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        roots = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        if not roots:
            raise FileNotFoundError(self.root)
        begin = self.spark.createDataFrame([(r.getPath().toString(), True, 0, 0) for r in roots], FILES).coalesce(1)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folders = begin.mapInArrow(lambda batches: listed(batches, True), FILES)
        return folders.repartition(tasks, "path").mapInArrow(lambda batches: listed(batches, False), FILES).select("path", "length", "mtime")

    def _grown(self) -> DataFrame:
        """The files that have grown or changed, with what is known of them and ``new``, the bytes to read."""
        # cursors are as many as files, and each poll reads them: joins by shuffles keep them away from the driver
        by = "shuffle_hash"
        known = self.cursors.table(join=by)
        kinds = "key string, offset long, seen long, head string"
        known = known.select("key", "offset", "seen", "head") if known is not None else self.spark.createDataFrame([], kinds)
        rows = self.listing().join(known.hint(by), F.col("path") == F.col("key"), "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
        # a file of the same length may be another one if it was touched
        changed = rows.filter((F.col("length") != F.col("offset")) | (F.col("mtime") > F.coalesce("seen", F.lit(-1))))
        new = F.when(F.col("length") > F.col("offset"), F.col("length") - F.col("offset")).otherwise(F.col("length"))
        return changed.select("path", "offset", "length", "mtime", "head", new.alias("new"))

    def _plan(self) -> DataFrame:
        """The files of the next batch: from where to where, by whole lines."""
        # sums of bytes by a distributed sort: one row for each of its parts meets in a task, so a batch may have any number of files
        kept = f"{self.state}/grown"
        self._grown().orderBy("mtime", "path").withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(kept)
        grown = self.spark.read.schema(GROWN).parquet(kept).withColumn("part", F.shiftright("at", 33))
        sizes = grown.groupBy("part").agg(F.sum("new").alias("size"))
        before = lambda of, window: F.coalesce(F.sum(of).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = sizes.select("part", (F.lit(self.max_bytes) - before("size", Window.orderBy("part"))).alias("room")).filter("room > 0")
        within = before("new", Window.partitionBy("part").orderBy("at"))
        taken = grown.join(parts.hint("shuffle_hash"), "part").withColumn("left", F.col("room") - within).filter("left > 0")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    try:
                        f = opened(r["path"])
                    except FileNotFoundError:  # it went between listing and now
                        continue
                    with f:
                        same = r["length"] >= r["offset"] and (r["head"] is None or head_of(f, r["offset"]) == r["head"])
                        begin = r["offset"] if same else 0
                        stop = stop_of(f, begin, min(r["length"], begin + r["left"]), r["length"])
                        # a file of which more is left keeps the time at which it was not yet read
                        out.append({"path": r["path"], "first": begin, "stop": stop, "length": r["length"], "mtime": r["mtime"], "head": head_of(f, stop)})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("length", pa.int64()), ("mtime", pa.int64()), ("head", pa.string())]))

        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return taken.select("path", "offset", "length", "mtime", "left", "head").repartition(tasks, "path").mapInArrow(look, PLAN)

    def _read(self, plan: DataFrame) -> DataFrame:
        size = self.piece
        pieces = plan.filter("stop > first").withColumn("begin", F.explode(F.sequence(F.col("first"), F.col("stop") - 1, F.lit(size))))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    with opened(r["path"]) as f:
                        name = r["path"].rsplit("/", 2)
                        held, held_bytes = [], 0
                        for at, line in lines_in(f, r["first"], r["begin"], r["begin"] + size, r["stop"]):
                            held.append((at, line))
                            held_bytes += len(line)
                            if held_bytes > 1 << 20:
                                yield made(r["path"], name, held)
                                held, held_bytes = [], 0
                        if held:
                            yield made(r["path"], name, held)

        def made(path: str, name: list[str], rows: list[tuple[int, str]]) -> pa.RecordBatch:
            n = len(rows)
            session = name[2].removesuffix(".jsonl")
            return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name[1]] * n), pa.array([session] * n), pa.array([a for a, _ in rows], pa.int64()), pa.array([x for _, x in rows])], ["path", "project", "session", "at", "value"])

        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return pieces.repartition(tasks, "path", "begin").mapInArrow(read, LINES)

    def poll(self) -> int:
        """Land the next batch; the number of bytes in it, 0 if nothing has grown.

        A batch is planned first, then landed, then its cursors are stored. A poll that was killed is taken up where it stood:
        by its plan, so files that grew since do not change it, and without landing again what has landed.
        """
        version, now = self.manifest.read()
        n = now.get("batch", 0)
        plan = f"{self.state}/plans/{n}"
        if not exists(self.spark, f"{plan}/_SUCCESS"):
            self._plan().write.mode("overwrite").parquet(plan)
        rows = self.spark.read.schema(PLAN).parquet(plan)
        size = rows.agg(F.sum(F.col("stop") - F.col("first"))).first()[0] or 0
        if size and not exists(self.spark, f"{self.lines}/{n}/_SUCCESS"):
            self._read(rows).write.mode("overwrite").parquet(f"{self.lines}/{n}")
        stamp = F.lit(f"{n:012d}")
        # what is left of a file is seen again: its time counts once all of it is read
        seen = F.when(F.col("stop") == F.col("length"), F.col("mtime")).otherwise(F.lit(-1))
        self.cursors.append(rows.select(F.col("path").alias("key"), F.lit(n).cast("long").alias("seq"), stamp.alias("updated_at"), stamp.alias("created_at"), F.col("stop").alias("offset"), seen.cast("long").alias("seen"), "head"), "tail", n)
        self.manifest.write(version + 1, {"batch": n + 1})
        self.manifest.prune()
        return size

    def catch_up(self) -> int:
        """Poll until nothing has grown; the number of batches with lines."""
        batches = 0
        while self.poll():
            batches += 1
        return batches

    def landed(self) -> DataFrame:
        """All lines that have landed."""
        done = [n for n in range(self.manifest.read()[1].get("batch", 0)) if exists(self.spark, f"{self.lines}/{n}/_SUCCESS")]
        return self.spark.read.schema(LINES).parquet(*[f"{self.lines}/{n}" for n in done]) if done else self.spark.createDataFrame([], LINES)

    def stream(self) -> DataFrame:
        """The landed lines as a stream, for ``session_stream`` and others."""
        return self.spark.readStream.schema(LINES).parquet(f"{self.lines}/*")
