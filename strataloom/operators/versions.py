"""Versions of a stored table: small JSON files of which each is created once; the last complete one is what readers see."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class Versions:
    """Data files are written before a version names them, under names of their own; what no version names is not seen.

    A version file is created exclusively, so of two writers that start from the same version one gets a Conflict. A file
    that was not written to its end does not parse: readers pass over it, and the next writer takes the number after it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/versions"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, number: int) -> dict[str, Any] | None:
        at = self._path(f"{self.folder}/v{number:09d}.json")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def last(self) -> tuple[int, dict[str, Any] | None]:
        """(number, content) of the last complete version; (0, None) without one."""
        for n in reversed(self._numbers()):
            if (content := self.read(n)) is not None:
                return n, content
        return 0, None

    def commit(self, after: int, content: dict[str, Any]) -> int:
        """Makes the version after the one numbered `after`, which the content was made from. Numbers of broken files are
        passed over; a complete version beyond `after` is a Conflict."""
        number = after + 1
        while self._fs.exists(self._path(f"{self.folder}/v{number:09d}.json")):
            if self.read(number) is not None:
                raise Conflict(f"version {number} is there already")
            number += 1
        try:
            stream = self._fs.create(self._path(f"{self.folder}/v{number:09d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {number} is being made by another writer") from e
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        return number

    def forget(self, keep: int) -> None:
        """Deletes all versions but the last `keep` complete ones."""
        whole = [n for n in self._numbers() if self.read(n) is not None]
        for n in whole[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/v{n:09d}.json"), False)

    def list(self, folder: str) -> list[str]:
        """Names below a folder; none if it isn't there."""
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
