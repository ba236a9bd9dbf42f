"""A table that is written to again and again by key: hash buckets of files under versions.

A change reads and rewrites only the buckets that its keys fall in; the others' files are named again by the next version.
A batch id makes a repeated change harmless. A change that fails on its way leaves files that no version names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ingest
from .versions import Conflict, Versions

#: Times a change starts again when another writer was first.
TRIES = 5


class KeyedTable:
    """Rows by key. `buckets` is fixed when the table is made: about 128 MB a bucket is a good size."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, self.folder)

    @staticmethod
    def create(spark: SparkSession, folder: str, schema: StructType | str, key: list[str], buckets: int = 16) -> KeyedTable:
        """A new empty table; an error if there is one."""
        table = KeyedTable(spark, folder)
        kind = spark.createDataFrame([], schema).schema
        if missing := [k for k in key if k not in kind.fieldNames()]:
            raise ValueError(f"no such key column: {missing}")
        table.versions.commit(0, {"schema": kind.json(), "key": key, "buckets": buckets, "files": {}, "batch": None})
        return table

    def state(self) -> tuple[int, dict]:
        number, content = self.versions.last()
        if content is None:
            raise ValueError(f"no table at {self.folder}")
        return number, content

    def read(self, at: int | None = None) -> DataFrame:
        """The rows of the last version, or of a kept earlier one."""
        content = self.state()[1] if at is None else self.versions.read(at)
        if content is None:
            raise ValueError(f"no version {at}")
        return self._rows(content, list(content["files"].values()))

    def _rows(self, content: dict, paths: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(content["schema"]))
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{p}" for p in paths])

    # --- changes ---------------------------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, order: list[Column], batch: str | None = None) -> int:
        """Rows replace those of their key; of rows that share one the last by `order` wins. Gives the version."""
        return self._change(rows, batch, lambda old, new, key: ingest.upsert(old, new, key, order))

    def insert(self, rows: DataFrame, order: list[Column], batch: str | None = None) -> int:
        """Adds rows whose key isn't there; the first of those that share one."""
        return self._change(rows, batch, lambda old, new, key: ingest.insert_if_absent(old, new, key, order))

    def update(self, changes: DataFrame, column: str, only_null: bool = False, batch: str | None = None) -> int:
        """Sets a column from changes (key, column); keys that aren't there do nothing."""
        return self._change(changes, batch, lambda old, new, key: ingest.update(old, new, key, column, only_null))

    def delete(self, keys: DataFrame, batch: str | None = None) -> int:
        return self._change(keys, batch, lambda old, new, key: old.join(new.select(*key).distinct(), key, "left_anti"))

    def done(self, batch: str) -> bool:
        """Whether a version took this batch."""
        number = self._claimed(batch)
        return number is not None and (self.versions.read(number) or {}).get("batch") == batch

    def _claim(self, batch: str) -> str:
        return f"{self.folder}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _claimed(self, batch: str) -> int | None:
        own = [int(n) for n in self.versions.list(self._claim(batch)) if n.isdigit()]
        taken = [n for n in own if (self.versions.read(n) or {}).get("batch") == batch]
        return taken[0] if taken else (own[-1] if own else None)

    def _change(self, rows: DataFrame, batch: str | None, apply: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> int:
        for tries in range(TRIES):
            number, content = self.state()
            if batch is not None and self.done(batch):
                return number
            try:
                return self._changed(number, content, rows, batch, apply)
            except Conflict:
                if tries + 1 == TRIES:
                    raise
        raise AssertionError

    def _changed(self, number: int, content: dict, rows: DataFrame, batch: str | None, apply) -> int:
        key, buckets = content["key"], content["buckets"]
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        name = uuid.uuid4().hex
        # rows may be costly or not the same twice: they are stored once, and tell which buckets they touch
        incoming = f"{self.folder}/incoming/{name}"
        rows.where(" and ".join(f"{k} is not null" for k in key)).write.parquet(incoming)
        new = self.spark.read.schema(rows.schema).parquet(incoming)
        touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # at most as many as there are buckets
        old = self._rows(content, [content["files"][str(b)] for b in touched if str(b) in content["files"]])
        after = apply(old, new, key).select(*old.columns).withColumn("bucket", bucket)
        after.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
        written = {n.removeprefix("bucket=") for n in self.versions.list(f"{self.folder}/data/{name}") if n.startswith("bucket=")}
        files = {b: p for b, p in content["files"].items() if int(b) not in touched}
        files |= {b: f"data/{name}/bucket={b}" for b in written}
        if batch is not None:
            # a claim counts only if the version it names is of this batch
            self.versions._fs.mkdirs(self.versions._path(f"{self._claim(batch)}/{self._next(number)}"))
        made = self.versions.commit(number, content | {"files": files, "batch": batch, "touched": touched})
        if batch is not None and made != self._next(number):
            self.versions._fs.mkdirs(self.versions._path(f"{self._claim(batch)}/{made}"))
        self.versions.delete(incoming)
        return made

    @staticmethod
    def _next(number: int) -> int:
        return number + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes data that none of the last `keep` versions names, and what failed changes left. Versions stay as they
        tell which batches were taken; their data may be gone. Not while others write or read."""
        last, _ = self.state()
        numbers = [n for n in range(last, 0, -1) if self.versions.read(n) is not None][:keep]
        named = {p.split("/")[1] for n in numbers for p in (self.versions.read(n) or {})["files"].values()}
        stray = [n for n in self.versions.list(f"{self.folder}/data") if n not in named]
        for n in stray:
            self.versions.delete(f"{self.folder}/data/{n}")
        self.versions.delete(f"{self.folder}/incoming")
        return stray


def upsert_batches(
    table: KeyedTable, batches: Iterable[tuple[str, DataFrame]], order: list[Column], fault: Column | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Upserts batch after batch: (batch, status, taken, refused, error) for each. Rows for which `fault` gives a reason are
    refused and counted; a batch that fails leaves the table as it was and a row with its error, and the next go on. A batch
    that was taken before is `repeated` and changes nothing."""
    out = []
    for name, rows in batches:
        try:
            if table.done(name):
                out.append((name, "repeated", 0, 0, None))
                continue
            ready = prepare(rows) if prepare else rows
            kept = f"{table.folder}/incoming/{uuid.uuid4().hex}"
            ready.withColumn("__fault", F.lit(None).cast("string") if fault is None else fault).write.parquet(kept)
            told = table.spark.read.parquet(kept)
            taken, refused = told.agg(F.count(F.when(F.col("__fault").isNull(), 1)), F.count("__fault")).first()
            table.upsert(told.where("__fault is null").drop("__fault"), order, name)
            table.versions.delete(kept)
            out.append((name, "taken", taken, refused, None))
        except Exception as e:  # what made a batch fail is told in its row
            out.append((name, "failed", 0, 0, _reason(e)))
    return table.spark.createDataFrame(out, "batch string, status string, taken long, refused long, error string")


def _reason(error: Exception) -> str:
    """The condition that Spark names, or the kind of error."""
    condition = getattr(error, "getCondition", lambda: None)()
    return condition or type(error).__name__
