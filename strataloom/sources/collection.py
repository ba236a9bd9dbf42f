"""A collection that is read in pages by offset: a data source with planned partitions, pushed filters and a stream.

A collection is a folder of Parquet files (or one file), as an exporter of vector databases leaves it; new files have names
after the old ones. A row's offset is its place in the order of files, row groups and rows. `scan` and `resume` use it like
any other source: spark.read.format("collection").option("path", ...).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema

from ..operators.versions import Versions
from ..runtime import ship

NAME, OFFSET = "collection", "_offset"
#: Rows of a partition, at most; a partition lies in one row group.
PARTITION_ROWS = 100_000
_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Page(InputPartition):
    """Rows `begin` to `end` of a row group, of which the first has the given offset."""

    file: str
    group: int
    begin: int
    end: int
    offset: int


def _groups(path: str) -> Iterator[tuple[str, int, int, pq.RowGroupMetaData]]:
    """(file, row group, rows, metadata) in order; footers only are read."""
    store, at = _open(path)
    info = store.get_file_info(at)
    files = [at] if info.is_file else sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.is_file and x.path.endswith(".parquet"))
    for file in files:
        with store.open_input_file(file) as f:
            meta = pq.ParquetFile(f).metadata
            for i in range(meta.num_row_groups):
                yield file, i, meta.row_group(i).num_rows, meta.row_group(i)


def _may_hold(group: pq.RowGroupMetaData, filters: list[Filter]) -> bool:
    """Whether a row group's statistics let rows pass."""
    columns = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
    for f in filters:
        s = columns.get(f.attribute[0])
        if s is None or not s.has_min_max:
            continue
        low, high = s.min, s.max
        values = f.value if isinstance(f, In) else (f.value,)
        if isinstance(f, EqualTo | In) and not any(v is not None and low <= v <= high for v in values):
            return False
        if isinstance(f, GreaterThan) and not high > f.value or isinstance(f, GreaterThanOrEqual) and not high >= f.value:
            return False
        if isinstance(f, LessThan) and not low < f.value or isinstance(f, LessThanOrEqual) and not low <= f.value:
            return False
    return True


def _pages(path: str, begin: int, end: int | None, size: int, filters: list[Filter]) -> list[Page]:
    out, at = [], 0
    for file, i, rows, group in _groups(path):
        first, last = max(begin - at, 0), min(rows, rows if end is None else end - at)
        if first < last and _may_hold(group, filters):
            out += [Page(file, i, b, min(b + size, last), at + b) for b in range(first, last, size)]
        at += rows
    return out


def _read(path: str, page: Page, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    store, _ = _open(path)
    with store.open_input_file(page.file) as f:
        table = pq.ParquetFile(f).read_row_group(page.group).slice(page.begin, page.end - page.begin)
    table = table.append_column(OFFSET, pa.array(range(page.offset, page.offset + len(table)), pa.int64()))
    for x in filters:
        column = table.column(x.attribute[0])
        keep = pc.is_in(column, pa.array(list(x.value), column.type)) if isinstance(x, In) else _TESTS[type(x)](column, pa.scalar(x.value, column.type))
        table = table.filter(keep)
    yield from table.to_batches(max_chunksize=10_000)


class CollectionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.filters = options["path"], []
        self.begin, self.size = int(options.get("offset", 0)), int(options.get("partitionrows", PARTITION_ROWS))
        self.end = self.begin + int(options["limit"]) if "limit" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of plain columns with values; Spark applies the others."""
        for f in filters:
            if isinstance(f, (*_TESTS, In)) and len(f.attribute) == 1 and f.attribute[0] != OFFSET:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Page]:
        return _pages(self.path, self.begin, self.end, self.size, self.filters) or [Page("", -1, 0, 0, 0)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if page.file:
            yield from _read(self.path, page, self.filters)


class CollectionStream(DataSourceStreamReader):
    """Reads what stands between two offsets; files that come later go on from there."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("partitionrows", PARTITION_ROWS))
        self.first = int(options.get("offset", 0))

    def initialOffset(self) -> dict:
        return {"offset": self.first}

    def latestOffset(self) -> dict:
        return {"offset": max(self.first, sum(rows for _, _, rows, _ in _groups(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return _pages(self.path, start["offset"], end["offset"], self.size, [])

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, page, [])

    def commit(self, end: dict) -> None:
        pass


class CollectionSource(DataSource):
    """Options: path; offset and limit (rows to pass over and to read); partitionRows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        store, _ = _open(self.options["path"])
        file = next(_groups(self.options["path"]), None)
        if file is None:
            raise ValueError(f"no collection at {self.options['path']}")
        with store.open_input_file(file[0]) as f:
            own = pq.ParquetFile(f).schema_arrow
        return from_arrow_schema(own.append(pa.field(OFFSET, pa.int64())))

    def reader(self, schema) -> DataSourceReader:
        return CollectionReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CollectionStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)


def pages(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(NAME).option("path", path).option("offset", str(offset))
    return (reader if limit is None else reader.option("limit", str(limit))).load()


class Copy:
    """A copy of a collection that goes on where it stopped: rows and the offset they reach are committed as one version."""

    def __init__(self, spark: SparkSession, path: str, target: str):
        self.spark, self.path, self.target = spark, path, target.rstrip("/")
        self.versions = Versions(spark, self.target)

    @property
    def offset(self) -> int:
        return (self.versions.last()[1] or {"offset": 0})["offset"]

    def plan(self) -> tuple[int, int]:
        """(rows that are left, rows of the collection): what a dry run tells."""
        total = sum(rows for _, _, rows, _ in _groups(self.path))
        return total - self.offset, total

    def step(self, rows: int, clean=lambda df: df) -> bool:
        """Copies the next `rows` rows through `clean`; False if there are none left. A step that dies is not seen, and the
        next one starts at the same offset."""
        left, total = self.plan()
        if left <= 0:
            return False
        number, content = self.versions.last()
        content = content or {"offset": 0, "parts": []}
        part = f"data/{uuid.uuid4().hex}"
        clean(pages(self.spark, self.path, content["offset"], rows)).write.parquet(f"{self.target}/{part}")
        self.versions.commit(number, {"offset": min(content["offset"] + rows, total), "parts": [*content["parts"], part]})
        return True

    def run(self, rows: int, clean=lambda df: df) -> DataFrame:
        while self.step(rows, clean):
            pass
        return self.read()

    def recreate(self) -> None:
        """Starts anew at offset 0; the rows of before go with the next vacuum()."""
        self.versions.commit(self.versions.last()[0], {"offset": 0, "parts": []})

    def read(self) -> DataFrame:
        parts = (self.versions.last()[1] or {"parts": []})["parts"]
        if not parts:
            raise ValueError("nothing is copied yet")
        return self.spark.read.parquet(*[f"{self.target}/{p}" for p in parts])

    def vacuum(self) -> int:
        named = {p.split("/")[1] for p in (self.versions.last()[1] or {"parts": []})["parts"]}
        stray = [n for n in self.versions.list(f"{self.target}/data") if n not in named]
        for n in stray:
            self.versions.delete(f"{self.target}/data/{n}")
        return len(stray)


def follow(spark: SparkSession, path: str, sink: str, checkpoint: str, clean=lambda df: df, offset: int = 0):
    """Copies what is new in a collection as a stream, and ends. A batch's folder is overwritten if it comes again."""
    register(spark)
    source = spark.readStream.format(NAME).option("path", path).option("offset", str(offset)).load()

    def batch(rows: DataFrame, number: int) -> None:
        clean(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def offset_of(path: str) -> int:
    """Where a stream stands that begins after all that is there now."""
    return sum(rows for _, _, rows, _ in _groups(path))


def described(path: str) -> str:
    """Files, row groups and rows of a collection, as JSON."""
    per: dict[str, list[int]] = {}
    for file, _, rows, _ in _groups(path):
        per.setdefault(file.rpartition("/")[2], []).append(rows)
    return json.dumps({"files": len(per), "groups": sum(map(len, per.values())), "rows": sum(map(sum, per.values()))})
