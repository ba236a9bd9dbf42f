"""Shared pieces: scratch tables on shared storage, guarded broadcasts, hash splits, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Rows that go to a Python worker at a time while a table is stored: texts are long, and both sides hold a batch twice.
BATCH_ROWS, BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows below which a table of narrow rows is broadcast; its rows are counted first.
BROADCAST_ROWS = 20_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder; a new local one
    where neither is set and all runs on one machine (tests). An error on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ctx = spark.sparkContext
        found = ctx._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not (ctx.master or "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            ctx.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
            found = ctx._jsc.sc().getCheckpointDir()
        root = found.get()
    return root.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder. Losing an executor loses none of them.

    Tables that a returned DataFrame still reads stay until clear() is called by the owner, or, for all that were opened
    since, clear_since() by one who has stored the result.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str = "work"):
        ship(spark)
        Scratch.opened.append(self)
        self.spark, self.n = spark, 0
        self.root = f"{shared_root(spark)}/strataloom/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and give it back as read from storage, with its lineage cut."""
        path = self.path(name)
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def clear(self) -> None:
        self._delete(self.root)
        if self in Scratch.opened:
            Scratch.opened.remove(self)

    @staticmethod
    def clear_since(n: int) -> None:
        """Clears what was opened after the first n."""
        for scratch in Scratch.opened[n:]:
            scratch.clear()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows it to be small, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: The operator whose caches this worker keeps from task to task, and what drops them.
_HOLDER: list[tuple[str, Callable[[], None]]] = []


def hold(owner: str, drop: Callable[[], None]) -> None:
    """To be called where a task of `owner` begins: the caches of the operator that ran here before are dropped and their
    memory is given back, as a worker lives through all stages of a job. A task may keep what it has taken from a cache."""
    if _HOLDER and _HOLDER[0][0] == owner:
        return
    for _, before in _HOLDER:
        before()
    if _HOLDER:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    _HOLDER[:] = [(owner, drop)]


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the held-out fold: crc32 of its key as text leaves no remainder."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def null_key(column: Column) -> list[Column]:
    """Two columns that equal for equal values, nulls included, so that nulls can join."""
    return [column.isNull(), F.coalesce(column, F.lit(""))]


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b): root is the least node reachable.

    Alternates large-star and small-star steps, each a map-side combined minimum and an equi-join, so a hub's rows can
    be split by adaptive execution. Ends when a round changes nothing. Self-loops and repeated edges do no harm; an
    empty edge table gives an empty result.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.keep(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "star")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
