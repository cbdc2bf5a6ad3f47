"""Several sources side by side: polls and safety sweeps, failures that stay with their source, and a table of what happened."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = "at double, source string, event string, batch long, rows long, detail string"


class Recorder(StreamingQueryListener):
    """What Spark tells of the queries of a run: each micro-batch with its rows, and why a query ended."""

    def __init__(self) -> None:
        self.lock, self.found, self.ended = threading.Lock(), [], set()

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        self._add(event.runId, "started", None, None, None)

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        p = event.progress
        self._add(p.runId, "batch", p.batchId, p.numInputRows, None)

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        self._add(event.runId, "terminated", None, None, (event.exception or "")[:4000] or None)
        with self.lock:
            self.ended.add(str(event.runId))

    def _add(self, run: object, event: str, batch: int | None, rows: int | None, detail: str | None) -> None:
        with self.lock:
            self.found.append((str(run), event, batch, rows, detail))

    def of(self, run: str, wait: float) -> list[tuple]:
        """The events of a run that has ended; they arrive a little later than the query ends."""
        until = time.monotonic() + wait
        while time.monotonic() < until:
            with self.lock:
                if run in self.ended:
                    break
            time.sleep(0.05)
        with self.lock:
            mine = [x for x in self.found if x[0] == run]
            self.found = [x for x in self.found if x[0] != run]
            self.ended.discard(run)
        return mine


@dataclass
class Source:
    """``start(full)`` runs what is there: it returns a streaming query that ends by itself, or a number of rows, or nothing."""

    name: str
    start: Callable
    every: float = 5.0
    sweep: float | None = 30.0  # seconds between full passes; None for none
    next: float = 0.0
    next_sweep: float = 0.0
    failures: int = 0
    events: list[tuple] = field(default_factory=list)


class StreamRunner:
    """Run sources again and again, each in its own thread; a source that fails waits longer each time and holds up no other."""

    def __init__(self, spark: SparkSession, path: str, backoff: float = 1.0, longest: float = 300.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.spark, self.path, self.backoff, self.longest, self.clock, self.sleep = spark, path, backoff, longest, clock, sleep
        self.sources: list[Source] = []
        self.stopped = threading.Event()

    def add(self, name: str, start: Callable, every: float = 5.0, sweep: float | None = 30.0) -> StreamRunner:
        self.sources.append(Source(name, start, every, sweep))
        return self

    def stop(self) -> None:
        self.stopped.set()

    def _once(self, s: Source, now: float, recorder: Recorder) -> None:
        full = s.sweep is not None and now >= s.next_sweep
        try:
            made = s.start(full)
            rows = made if isinstance(made, int) else None
            if hasattr(made, "awaitTermination"):
                run = str(made.runId)
                try:
                    made.awaitTermination()
                finally:
                    told = recorder.of(run, 10)
                    s.events += [(now, s.name, event, batch, n, detail) for _, event, batch, n, detail in told]
                rows = sum(n or 0 for _, event, _, n, _ in told if event == "batch")
        except Exception as problem:  # noqa: BLE001  whatever a source does, the others go on
            s.failures += 1
            s.events.append((now, s.name, "failed", None, None, f"{type(problem).__name__}: {problem}"[:4000]))
            s.next = now + min(self.longest, self.backoff * 2 ** (s.failures - 1))
            return
        s.failures = 0
        s.events.append((now, s.name, "sweep" if full else "poll", None, rows, None))
        s.next = now + s.every
        if full:
            s.next_sweep = now + s.sweep

    def run(self, rounds: int | None = None) -> StreamRunner:
        """Run what is due until ``stop``, or for so many rounds; each round ends when its sources have, and its events are stored."""
        recorder = Recorder()
        self.spark.streams.addListener(recorder)
        try:
            with ThreadPoolExecutor(max(1, len(self.sources))) as pool:
                while not self.stopped.is_set() and (rounds is None or rounds > 0):
                    now = float(self.clock())
                    list(pool.map(lambda s: self._once(s, now, recorder), [s for s in self.sources if s.next <= now]))  # noqa: B023
                    self._store()
                    rounds = rounds - 1 if rounds is not None else None
                    if rounds != 0:
                        self.sleep(max(0.0, min(s.next for s in self.sources) - self.clock()))
        finally:
            self.spark.streams.removeListener(recorder)
        return self

    def _store(self) -> None:
        rows = [x for s in self.sources for x in s.events]
        for s in self.sources:
            s.events = []
        if rows:
            self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        """at, source, event (started, batch, terminated; poll, sweep, failed), batch, rows, detail."""
        return self.spark.read.schema(EVENTS).parquet(self.path)
