"""Pages by rank: the right rows from one range."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from strataloom.operators import paged
from strataloom.operators.paged import PagedTable


def test_pages(spark, tmp_path):
    rows = [(i * 7919 % 1000, i % 3 if i % 10 else None, f"t{i}") for i in range(1000)]
    table = PagedTable(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        table.page(1)
    assert table.store(spark.createDataFrame(rows, "id long, g int, t string"), ["desc g", "id"], range_rows=100) == 1000
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for n in (1, 2, 9, 20):
        page = table.page(n, 50)
        got = [tuple(r) for r in page.rows.orderBy("rank").collect()]
        assert got == [(*r, (n - 1) * 50 + i) for i, r in enumerate(want[(n - 1) * 50 : n * 50])]
        assert (page.pages, page.total, page.has_prev, page.has_next) == (20, 1000, n > 1, n < 20)
    folders = {f.rpartition("/")[0] for f in table.ranks(130, 140).inputFiles()}
    assert 1 <= len(folders) <= 2 and len(table._state()["ranges"]) >= 8
    assert table.page(21, 50).rows.count() == 0 and table.page(4, 300).rows.count() == 100
    assert sum(p.rows.count() for p in table.walk(400)) == 1000
    for bad in ((0, 5), (1, 0)):
        with pytest.raises(ValueError):
            table.page(*bad)
    assert table.store(spark.createDataFrame([], "id long, g int, t string"), ["id"]) == 0
    empty = table.page(1)
    assert empty.rows.count() == 0 and not empty.has_next and not empty.has_prev and empty.rows.columns == ["id", "g", "t", "rank"]


def test_few_tasks_make_many_ranges(spark, tmp_path, monkeypatch):
    """A task for each range sends a hundred keys of each to the driver."""
    asked = []
    was = DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *c: asked.append(n) or was(self, n, *c))
    monkeypatch.setattr(paged, "TASK_ROWS", 400)
    table = PagedTable(spark, str(tmp_path / "p"))
    table.store(spark.range(1000).repartition(5), ["desc id"], range_rows=10)
    assert asked == [3] and 100 <= len(table._state()["ranges"]) <= 103
    assert [r["id"] for p in table.walk(90) for r in p.rows.orderBy("rank").collect()] == list(range(999, -1, -1))
