"""Manifests by version: what readers of a store on disk may see.

A manifest is a new file ``manifest/<version>.json``, created exclusively: a write counts when it is there, a writer that
breaks off leaves the store as it was, and of two writers of the same version one gets an error.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made this version."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self.hadoop.Path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def _read(self, name: str) -> dict | None:
        stream = self.fs.open(self.hadoop.Path(f"{self.path}/manifest/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # its writer broke off
            return None
        finally:
            stream.close()

    def _latest(self) -> tuple[int, dict | None]:
        for name in reversed([x for x in self._names("manifest") if x.endswith(".json") and not x.startswith(".")]):
            found = self._read(name)
            if found is not None:
                return int(name.removesuffix(".json")), found
        return 0, None

    def version(self) -> int:
        return self._latest()[0]

    def _commit(self, version: int, manifest: dict) -> None:
        path = self.hadoop.Path(f"{self.path}/manifest/{version:012d}.json")
        if self.fs.exists(path) and self._read(path.getName()) is None:  # of a writer that broke off
            self.fs.delete(path, False)
        try:
            out = self.fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} is there already") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _vacuum(self, folder: str, used, keep: int) -> int:
        """Removes what the newest ``keep`` manifests don't name (``used(manifest)`` gives names), and older manifests."""
        names = self._names("manifest")
        named = {x for m in (self._read(n) for n in names[-keep:]) if m is not None for x in used(m)}
        gone = [x for x in self._names(folder) if x not in named]
        for x in gone:
            self.fs.delete(self.hadoop.Path(f"{self.path}/{folder}/{x}"), True)
        for x in names[:-keep]:
            self.fs.delete(self.hadoop.Path(f"{self.path}/manifest/{x}"), False)
        return len(gone)
