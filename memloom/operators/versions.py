"""Lists of a table's files in numbered versions, each written whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Manifest:
    """Versions of a small JSON document under ``path``; the highest number counts.

    A version is written beside its place and renamed, which fails if the place is taken: of two writers one gets a ``Conflict``
    and reads again. A writer that is lost leaves nothing that readers look at.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self) -> tuple[int, dict]:
        """The current version and its document: 0 and an empty one at the beginning."""
        found = self.versions()
        if not found:
            return 0, {}
        stream = self._fs.open(self._at(f"v{found[-1]:012d}.json"))
        try:
            return found[-1], json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, version: int, document: dict) -> None:
        """Make ``version``, the one after that which was read."""
        place, beside = self._at(f"v{version:012d}.json"), self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        stream.close()
        if self._fs.exists(place) or not self._fs.rename(beside, place):
            self._fs.delete(beside, False)
            raise Conflict(f"version {version} of {self.path} is there")

    def prune(self, keep: int = 10) -> None:
        """Delete all but the last ``keep`` versions of the list itself."""
        for n in self.versions()[:-keep]:
            self._fs.delete(self._at(f"v{n:012d}.json"), False)
