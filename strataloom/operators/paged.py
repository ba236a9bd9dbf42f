"""Pages of a large table by rank: ranges in order, stored apart with the number of rows before each.

A page is read from the one or two ranges that its ranks fall in, and only these are sorted; a query over the whole table
would sort all of it and pass over the rows before the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .versions import Versions

#: Rows of a range, about, and of the ranges that one task sorts.
RANGE_ROWS, TASK_ROWS = 200_000, 1_000_000


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    number: int
    pages: int
    total: int

    @property
    def has_next(self) -> bool:
        return self.number < self.pages

    @property
    def has_prev(self) -> bool:
        return self.number > 1 and self.total > 0


class PagedTable:
    """`order` are columns, each with `desc` in front for descending ones; with a unique one at the end pages are the same
    on every build. Nulls come last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, self.folder)

    @staticmethod
    def _columns(order: list[str]) -> list[Column]:
        return [F.desc_nulls_last(c[5:]) if c.startswith("desc ") else F.asc_nulls_last(c) for c in order]

    def store(self, rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> int:
        """Builds the table anew beside what is there, and puts it in its place; gives the number of rows."""
        number, _ = self.versions.last()
        count = rows.count()
        ranges = max(1, -(-count // range_rows))
        at = f"{self.folder}/ranges-{number + 1}"
        # Spark draws a hundred keys and more for each task to the driver: tasks are as many as their rows ask for, and
        # a task cuts what it has sorted to ranges
        tasks = min(ranges, max(1, -(-count // max(TASK_ROWS, range_rows))))
        dealt = rows.repartitionByRange(tasks, *self._columns(order)).sortWithinPartitions(*self._columns(order))
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        number_ = F.spark_partition_id().cast("long") * (1 << 33) + F.floor(place / range_rows)
        dealt.withColumn("_range", number_).write.mode("overwrite").partitionBy("_range").parquet(at)
        sizes = {r["_range"]: r["n"] for r in self.spark.read.parquet(at).groupBy("_range").agg(F.count("*").alias("n")).collect()} if count else {}
        before, total = [], 0
        for k in sorted(sizes):
            before.append([k, total, sizes[k]])
            total += sizes[k]
        self.versions.commit(number, {"ranges": before, "total": total, "order": order, "schema": rows.schema.simpleString()[7:-1] if not count else None, "at": at})
        return total

    def _state(self) -> dict:
        content = self.versions.last()[1]
        if content is None:
            raise ValueError(f"no table at {self.folder}")
        return content

    def ranks(self, begin: int, end: int) -> DataFrame:
        """Rows with the ranks begin to end - 1, from 0, in order, with their `rank`."""
        now = self._state()
        hit = [r for r in now["ranges"] if r[1] < end and r[1] + r[2] > begin]
        if not hit:
            return self._none(now)
        base = hit[0][1]
        rows = self.spark.read.option("basePath", now["at"]).parquet(*[f"{now['at']}/_range={r[0]}" for r in hit])
        order = self._columns(now["order"])
        few = rows.orderBy("_range", *order).limit(end - base).offset(max(0, begin - base)).drop("_range")
        # rows of one page only
        place = F.row_number().over(W.orderBy(*order)) + (max(begin, base) - 1)
        return few.withColumn("rank", place.cast("long"))

    def _none(self, now: dict) -> DataFrame:
        if now["schema"]:
            return self.spark.createDataFrame([], now["schema"].replace("struct<", "")).withColumn("rank", F.lit(0).cast("long"))
        return self.spark.read.parquet(now["at"]).drop("_range").withColumn("rank", F.lit(0).cast("long")).limit(0)

    def page(self, number: int, size: int = 50) -> Page:
        """Page `number`, from 1; numbers beyond the last page have no rows."""
        if number < 1 or size < 1:
            raise ValueError("pages count from 1 and have a row at least")
        total = self._state()["total"]
        return Page(self.ranks((number - 1) * size, number * size), number, -(-total // size), total)

    def walk(self, size: int = 50) -> Iterator[Page]:
        for n in range(1, -(-self._state()["total"] // size) + 1):
            yield self.page(n, size)
