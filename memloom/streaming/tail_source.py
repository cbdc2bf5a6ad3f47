"""A streaming source that tails growing log files, and the jobs that run on streams."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memloom.operators.upsert_log import UpsertLog
from memloom.sources.records import session_records

SCHEMA = "path string, project string, session string, at long, value string"
#: Bytes that are looked at in one step.
STEP = 1 << 16


def last_line_end(path: str, begin: int, size: int) -> int:
    """Offset after the last newline of bytes begin..size, begin without one; the file is read from its end, step by step."""
    with open(path, "rb") as f:
        while size > begin:
            at = max(begin, size - STEP)
            f.seek(at)
            found = f.read(size - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            size = at
    return begin


def lines_between(path: str, begin: int, end: int, stop: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that start in bytes begin..end; the last may reach up to ``stop``, where a line ends."""
    with open(path, "rb") as f:
        f.seek(begin)
        at = begin
        while at < end:
            line = f.readline(stop - at)
            if not line.endswith(b"\n"):
                return
            yield at, line[:-1].decode("utf-8", "replace")
            at += len(line)


class Piece(InputPartition):
    """A part of one file: the lines that start in bytes begin..end, and where the batch ends in that file."""

    def __init__(self, path: str, inode: int, begin: int, end: int, first: int, stop: int) -> None:
        self.path, self.inode, self.begin, self.end, self.first, self.stop = path, inode, begin, end, first, stop


class TailReader(DataSourceStreamReader):
    """Offsets are {path: [inode, offset]}; a shorter or another file under a known path starts over.

    Only lines that end in a newline are read, so a line that is still being written waits, however long it gets. The
    driver looks for the last newline of each file that grew; executors read the lines, ``max_bytes`` of a file in a task.
    Option ``root`` holds <project>/<session>.jsonl and must be a folder that all of them see.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.max_bytes = options["root"], int(options.get("max_bytes", 64 << 20))
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = {}
        for path in sorted(Path(self.root).glob("*/*.jsonl")):
            stat = path.stat()
            old = self.known.get(str(path))
            begin = old[1] if old and old[0] == stat.st_ino and old[1] <= stat.st_size else 0
            now[str(path)] = [stat.st_ino, last_line_end(str(path), begin, stat.st_size)]
        self.known = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (inode, stop) in sorted(after.items()):
            old = before.get(path)
            begin = old[1] if old and old[0] == inode and old[1] <= stop else 0
            out += [Piece(path, inode, at, min(stop, at + self.max_bytes), begin, stop) for at in range(begin, stop, self.max_bytes)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not os.path.exists(piece.path) or os.stat(piece.path).st_ino != piece.inode:
            return
        p = Path(piece.path)
        begin = piece.begin
        if begin > piece.first:  # a line that began before belongs to the piece before
            with open(piece.path, "rb") as f:
                f.seek(begin - 1)
                begin += len(f.readline(piece.stop - begin + 1)) - 1
        for at, line in lines_between(piece.path, begin, piece.end, piece.stop):
            yield piece.path, p.parent.name, p.stem, at, line


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").option("root", ...)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def tail(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("jsonl_tail").option("root", root).load()


def upsert_stream(stream: DataFrame, silver: str, checkpoint: str, available_now: bool = True, interval: str = "5 seconds", force: str | None = None):
    """Keep a table of the newest version of each key: ``stream(key, seq, updated_at, created_at, ...)``, as an ``UpsertLog``.

    A batch writes its own versions only, and one that runs again, after its executors or the driver were lost, counts once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        UpsertLog(batch.sparkSession, silver, force).append(batch, checkpoint, batch_id)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def append_stream(stream: DataFrame, transform, path: str, checkpoint: str):
    """Append ``transform(stream)`` to a Parquet table: embeddings, archives. Runs over what is there and ends."""
    return transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_stream(stream: DataFrame, keys: list[str], embed, path: str, checkpoint: str):
    """Append the vector of each new text: ``keys`` and embedding; ``embed`` makes a Column of the column text.

    The first text of a key wins, within a batch and across them: the keys are the stream's state.
    """
    with keyed_state(stream.sparkSession):
        return append_stream(stream, lambda s: s.dropDuplicates(keys).select(*keys, embed(F.col("text")).alias("embedding")), path, checkpoint)


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, so it may be larger than memory and is saved by its changes."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def message_id(line: str) -> str | None:
    """What a log line counts as: the uuid of a message, "" for one without, None for what is no message of the main chain."""
    try:
        e = json.loads(line)
    except ValueError:
        return None
    if not isinstance(e, dict) or e.get("type") not in ("user", "assistant") or e.get("isSidechain"):
        return None
    said = e["message"].get("content") if isinstance(e.get("message"), dict) else None
    if isinstance(said, str) and said.lstrip().startswith("["):
        try:
            said = json.loads(said)
        except ValueError:
            pass
    if said is None or isinstance(said, list) and not any(isinstance(b, dict) for b in said):
        return None
    return str(e.get("uuid") or "")


class Sessions(StatefulProcessor):
    """State of a session: its lines, the ids of its messages, how many it has, and how many were last emitted.

    Emits all lines of a session whose number of messages changed. Lines from a place that was read before mean that the log began
    anew: what was known of it goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "at long, value string")
        self.ids = handle.getMapState("ids", "uuid string", "seen boolean")
        self.counts = handle.getValueState("counts", "n long, sent long, last long")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802, ANN001, ANN201
        # the new lines of one session; a batch's bytes are bounded by the source
        new = sorted((int(at), value) for frame in rows for at, value in zip(frame["at"], frame["value"], strict=True))
        n, sent, last = self.counts.get() or (0, 0, -1)
        if new and new[0][0] <= last:
            self.lines.clear()
            self.ids.clear()
            n, sent = 0, -1
        for _, line in new:
            uuid = message_id(line)
            if uuid is None or uuid and self.ids.containsKey((uuid,)):
                continue
            if uuid:
                self.ids.updateValue((uuid,), (True,))
            n += 1
        self.lines.appendList(new)
        changed = n != sent and n > 0
        self.counts.update((n, n if changed else sent, max([last if sent >= 0 else -1, *[at for at, _ in new]])))
        if changed:
            known = list(self.lines.get())
            yield pd.DataFrame({"project": key[0], "session": key[1], "block": 0, "at": [x[0] for x in known], "value": [x[1] for x in known]})

    def close(self) -> None:
        pass


def session_stream(stream: DataFrame, deliver, checkpoint: str):
    """Re-emit the whole record of every session whose number of messages changed: ``deliver(records, batch_id)``.

    What is known of a session is the stream's state, so a batch reads and writes its own sessions only, and side chains, notes
    and repeated messages emit nothing. A delivery that fails fails the batch, which the checkpoint then repeats.
    """
    kind = "project string, session string, block long, at long, value string"
    lines = stream.select("project", "session", "at", "value").groupBy("project", "session")
    with keyed_state(stream.sparkSession):
        changed = lines.transformWithStateInPandas(statefulProcessor=Sessions(), outputStructType=kind, outputMode="Update", timeMode="None")
        writer = changed.writeStream.outputMode("update").foreachBatch(lambda batch, n: deliver(session_records(batch), n))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
