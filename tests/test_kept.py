"""What is kept and takes changes: the index in segments against one built anew."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from strataloom.operators import kept_index, retrieval
from strataloom.operators.kept_index import KeptIndex
from strataloom.operators.keyed_table import KeyedTable, upsert_batches
from strataloom.operators.versions import Conflict, Versions
from strataloom.plans import catalog
from strataloom.sources import collection

random.seed(5)
WORDS = [f"w{i}" for i in range(300)]


def _text(i):
    r = random.Random(i)
    common = r.choices(WORDS, [1 / (1 + k) for k in range(300)], k=r.randint(0, 60))
    return " ".join(common + ([f"rare{i % 50}"] * 3 if i % 7 == 0 else []))


def _hits(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score", "normalised").collect()))


def test_segments_give_the_rows_of_a_rebuild(spark, tmp_path, monkeypatch):
    """Updates, deletes, documents that come back, merges: always as one index of what is in force; and few blocks are read."""
    monkeypatch.setattr(kept_index, "GROUP_DOCS", 8)
    state = {}
    index = KeptIndex(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "rare3 w0 w1"), (2, "w250 w299 w17 w17"), (3, "nothing known"), (4, ""), (5, None), (6, "rare21 rare14"), (7, "fresh words only")], "query_id long, question string")

    def put(rows):
        state.update({i: t for i, t in rows if i is not None and t is not None})
        index.upsert(spark.createDataFrame(rows, "id long, text string"), "id", "text")

    def drop(ids):
        for i in ids:
            state.pop(i, None)
        index.delete(spark.createDataFrame([(i,) for i in ids], "id long"), "id")

    def same():
        docs = spark.createDataFrame(list(state.items()), "id long, text string")
        assert _hits(index.search(asked, k=5)) == _hits(retrieval.bm25(asked, retrieval.text_index(docs, "id", "text"), k=5))
        assert index.size() == (len(state), sum(len((t or "").split()) for t in state.values()))

    put([(i, _text(i)) for i in range(400)] + [(None, "nobody"), (900, None), (901, "")])
    same()
    first, _, groups = index.plan(asked, 5)
    read = groups.groupBy("query_id").agg(F.count("*").alias("all"), F.count(F.when((F.col("place") <= 5) | F.col("again"), 1)).alias("read")).collect()
    read = {r["query_id"]: (r["all"], r["read"]) for r in read}
    assert read[1][1] < read[1][0] / 2 and read[6][1] <= read[6][0]
    put([(i, _text(i + 1000)) for i in range(100, 160)] + [(i, "fresh words " * (i % 3 + 1)) for i in range(500, 530)])
    same()
    drop([*range(140, 150), 501, 777])
    put([(145, "w0 rare3 is back"), (502, "w1 w1 w1")])
    same()
    assert not index.merge(fanout=4) and index.merge(fanout=3)
    same()
    now = index.snapshot()
    assert [s["level"] for s in now.segments] == [1] and not now.deletions
    drop([0, 7, 145])
    put([(1000 + i, _text(i)) for i in range(30)])
    same()
    stray = index.vacuum()
    assert len(stray) >= 3 and not index.vacuum()
    same()
    drop(list(state))
    assert index.search(asked).count() == 0 and index.size() == (0, 0)
    put([(1, "w0")])
    same()


def test_many_terms_join_and_empty_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept_index, "FILTER_TERMS", 2)
    index = KeptIndex(spark, str(tmp_path / "index"), "string")
    asked = spark.createDataFrame([(1, "w0 w1 w2 w3")], "query_id long, question string")
    assert index.search(asked).count() == 0 and not index.merge()
    index.upsert(spark.createDataFrame([("a", "w0 w1"), ("b", "w3")], "id string, text string"), "id", "text")
    assert [r["id"] for r in index.search(asked).orderBy("rank").collect()] == ["a", "b"]


def test_versions_are_made_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "t"))
    assert versions.last() == (0, None)
    assert versions.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        versions.commit(0, {"a": 2})
    (tmp_path / "t/versions/v000000002.json").write_text('{"a": 3')  # a writer that died
    assert versions.last() == (1, {"a": 1})
    assert versions.commit(1, {"a": 4}) == 3 and versions.last() == (3, {"a": 4})
    versions.forget(1)
    assert versions.read(1) is None and json.loads((tmp_path / "t/versions/v000000003.json").read_text()) == {"a": 4}


def _table(spark, tmp_path, n=200, buckets=8):
    table = KeyedTable.create(spark, str(tmp_path / "t"), "id long, name string, value double", ["id"], buckets)
    table.upsert(_rows(spark, {i: (f"n{i}", float(i)) for i in range(n)}), [F.col("value")], "load")
    return table


def _rows(spark, rows):
    return spark.createDataFrame([(i, *v) for i, v in rows.items()], "id long, name string, value double")


def _content(table, at=None):
    rows = table.read(at).collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: (r["name"], r["value"]) for r in rows}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    table = _table(spark, tmp_path)
    _, before = table.state()
    old = _content(table)
    version = table.upsert(_rows(spark, {5: ("five", 0.5), 1000: ("new", 1.0)}), [F.col("value")])
    _, after = table.state()
    changed = [b for b in after["files"] if after["files"][b] != before["files"].get(b)]
    assert sorted(map(int, changed)) == after["touched"] and 1 <= len(changed) <= 2 and len(before["files"]) == 8
    assert _content(table) == old | {5: ("five", 0.5), 1000: ("new", 1.0)} and _content(table, version - 1) == old
    table.insert(_rows(spark, {5: ("no", 0.0), 1001: ("yes", 2.0)}).unionByName(spark.createDataFrame([(None, "x", 0.0), (1002, "b", 2.0), (1002, "a", 1.0)], "id long, name string, value double")), [F.col("value")])
    table.update(spark.createDataFrame([(5, "5"), (6, "6"), (7777, "none")], "id long, name string"), "name")
    table.update(spark.createDataFrame([(8, "no"), (5, "no")], "id long, name string"), "name", only_null=True)
    table.delete(spark.createDataFrame([(7,), (8888,)], "id long"))
    want = old | {5: ("5", 0.5), 6: ("6", 6.0), 1000: ("new", 1.0), 1001: ("yes", 2.0), 1002: ("a", 1.0)}
    want.pop(7)
    assert _content(table) == want
    assert table.vacuum() and not table.vacuum() and _content(table) == want
    table.delete(table.read().select("id"))
    assert _content(table) == {} and table.read().columns == ["id", "name", "value"]


def test_a_commit_that_dies_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path)
    old, number = _content(table), table.state()[0]
    change = _rows(spark, {1: ("one", 1.5), 2: ("two", 2.5)})

    def die(self, after, content):
        (tmp_path / f"t/versions/v{after + 1:09d}.json").write_text('{"files": {"0"')
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", die)
        with pytest.raises(OSError):
            table.upsert(change, [F.col("value")], "b1")
    assert table.state()[0] == number and _content(table) == old and not table.done("b1")
    made = table.upsert(change, [F.col("value")], "b1")
    assert made == number + 2 and table.done("b1") and _content(table) == old | {1: ("one", 1.5), 2: ("two", 2.5)}
    assert table.upsert(change.withColumn("name", F.lit("again")), [F.col("value")], "b1") == made and _content(table)[1] == ("one", 1.5)
    assert table.vacuum()  # what the killed change has left


def test_writers_that_meet_both_take_effect(spark, tmp_path, monkeypatch):
    table, other = _table(spark, tmp_path), KeyedTable(spark, str(tmp_path / "t"))
    commit, meet = Versions.commit, [True]

    def first(self, after, content):
        if meet.pop() if meet else False:
            other.upsert(_rows(spark, {1: ("other", 0.0)}), [F.col("value")])
        return commit(self, after, content)

    monkeypatch.setattr(Versions, "commit", first)
    table.upsert(_rows(spark, {2: ("mine", 0.0)}), [F.col("value")])
    got = _content(table)
    assert got[1] == ("other", 0.0) and got[2] == ("mine", 0.0) and len(got) == 200
    with pytest.raises(Conflict):
        KeyedTable.create(spark, str(tmp_path / "t"), "id long", ["id"])
    with pytest.raises(ValueError):
        KeyedTable.create(spark, str(tmp_path / "u"), "id long", ["key"])


def test_batches(spark, tmp_path):
    """One is refused in part, one fails, one comes twice."""
    table = _table(spark, tmp_path, 10, 2)
    good = _rows(spark, {1: ("one", 1.5), 2: (None, 2.5)})
    bad = spark.createDataFrame([(3, "x", "word")], "id long, name string, value string")
    got = upsert_batches(
        table, [("a", good), ("b", bad), ("a", good), ("c", _rows(spark, {4: ("four", 4.0)}))], [F.col("value")], F.when(F.col("name").isNull(), "no name"),
        lambda rows: rows.withColumn("value", F.col("value").cast("double")),
    )
    assert [tuple(r) for r in got.collect()] == [("a", "taken", 1, 1, None), ("b", "failed", 0, 0, "CAST_INVALID_INPUT"), ("a", "repeated", 0, 0, None), ("c", "taken", 1, 0, None)]
    assert _content(table)[1] == ("one", 1.5) and _content(table)[2] == ("n2", 2.0) and _content(table)[3] == ("n3", 3.0)


def _collection(tmp_path, first, n, name="c"):
    (tmp_path / name).mkdir(exist_ok=True)
    table = pa.table({"id": pa.array(range(first, first + n), pa.int64()), "v": [f"v{i}" if i % 5 else None for i in range(first, first + n)]})
    pq.write_table(table, str(tmp_path / name / f"part-{first:06d}.parquet"), row_group_size=40)
    return str(tmp_path / name)


def test_pages_filters_and_offsets(spark, tmp_path):
    path = _collection(tmp_path, 0, 100)
    _collection(tmp_path, 100, 50)
    df = collection.pages(spark, path)
    assert df.columns == ["id", "v", "_offset"] and df.rdd.getNumPartitions() == 5
    assert [tuple(r) for r in df.where("id >= 99 and id < 101").collect()] == [(99, "v99", 99), (100, None, 100)]
    assert {r["id"] for r in collection.pages(spark, path, 95, 10).collect()} == set(range(95, 105))
    assert df.where("id in (3, 149, 900) and v is not null").count() == 2 and df.where("_offset = 7").count() == 1
    assert collection.pages(spark, path, 150).count() == 0
    reader = collection.CollectionReader({"path": path})
    assert not list(reader.pushFilters([EqualTo(("id",), 120)])) and len(reader.partitions()) == 1
    assert collection.described(path) == '{"files": 2, "groups": 5, "rows": 150}'


def test_a_copy_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    path = _collection(tmp_path, 0, 100)
    copy = collection.Copy(spark, path, str(tmp_path / "copy"))
    clean = lambda df: df.where("v is not null").select("id", "v")
    assert copy.plan() == (100, 100) and copy.step(30, clean) and copy.offset == 30
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            copy.step(30, clean)
    again = collection.Copy(spark, path, str(tmp_path / "copy"))
    assert again.plan() == (70, 100)
    _collection(tmp_path, 100, 20)
    assert sorted(r["id"] for r in again.run(45, clean).collect()) == [i for i in range(120) if i % 5]
    assert again.plan() == (0, 120) and not again.step(10) and again.vacuum() == 1
    again.recreate()
    assert again.plan() == (120, 120) and again.run(1000, clean).count() == 96


def test_a_stream_follows_a_collection(spark, tmp_path):
    path, sink, mark = _collection(tmp_path, 0, 60), str(tmp_path / "sink"), str(tmp_path / "mark")
    collection.follow(spark, path, sink, mark).awaitTermination(60)
    assert spark.read.parquet(sink).count() == 60
    _collection(tmp_path, 60, 30)
    collection.follow(spark, path, sink, mark).awaitTermination(60)
    collection.follow(spark, path, sink, mark).awaitTermination(60)
    got = [r["id"] for r in spark.read.parquet(sink).collect()]
    assert sorted(got) == list(range(90))


def test_nearest_in_parts_and_a_kept_coarse_index(spark, tmp_path):
    """Many blocks and parts of questions give the rows of one; a stored coarse index is loaded as it was."""
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1) + 3 * (i % 4 == j) for j in range(8)]) for i in range(400)] + [(400, None), (401, [0.0] * 8), (402, [1.0] * 7)]
    index = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = spark.createDataFrame([(1000 + i, [r.gauss(0, 1) + 3 * (i % 4 == j) for j in range(8)]) for i in range(60)] + [(2000, None), (2001, [1.0] * 7)], "query_id long, vector array<double>")
    one = sorted(map(tuple, retrieval.nearest(asked, index, "id", "v", blocks=1, parts=1).collect()))
    assert sorted(map(tuple, retrieval.nearest(asked, index, "id", "v", blocks=5, parts=3).collect())) == one and len(one) == 601
    assert retrieval._parts_of(index.withColumn("dim", F.size("v")).where("dim > 0"), "dim", 6400) == 5
    kept = retrieval.CellIndex(spark, str(tmp_path / "cells"))
    with pytest.raises(ValueError):
        kept.search(asked)
    kept.store(index, "id", "v", k=8)
    again = retrieval.CellIndex(spark, str(tmp_path / "cells"))
    state = again.state()
    assert state["recall"] >= retrieval.AUDIT_RECALL and 1 <= state["probes"] <= 8
    found = {(x["query_id"], x["id"]) for x in again.search(asked.where("query_id < 2000")).collect()}
    exact = {(x["query_id"], x["id"]) for x in retrieval.nearest(asked, index, "id", "v").where("query_id < 2000").collect()}
    assert len(found & exact) >= retrieval.RECALL * len(exact)


def test_texts_travel_in_no_shuffle(spark, tmp_path, monkeypatch):
    """A segment is cut and counted where texts lie: texts were dealt by key, each word by document, and lists twice by term."""
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("the"), F.col("id") % 7, F.col("id"), F.lit("the")).alias("text")).repartition(3)
    stored = []
    was = KeptIndex._store
    monkeypatch.setattr(KeptIndex, "_store", lambda self, held, level: stored.append(held) or was(self, held, level))
    index = KeptIndex(spark, str(tmp_path / "i"))
    index.upsert(docs, "id", "text")
    plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # the one of this test
    rows = index._rows(index.snapshot().segments).collect()
    assert sum(r["n"] for r in rows if r["term"] == "the") == 300 and all(r["n"] == len(r["postings"]) <= 64 for r in rows)
    for r in rows:
        pairs = {(p["tf"], p["dl"]) for p in r["postings"]}
        best = {p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)}
        assert [tuple(p) for p in r["best"]] == sorted(best, reverse=True) and [p["id"] for p in r["postings"]] == sorted(p["id"] for p in r["postings"])
    # a key that comes twice is there once
    index.upsert(docs.where("id < 5").unionByName(docs.where("id < 2")), "id", "text")
    index.merge(fanout=2)
    assert index.size() == (300, 1200) and len(index.snapshot().segments) == 1
    assert {tuple(r) for r in index.frequencies(spark.createDataFrame([("the",), ("3",), ("none",)], "term string")).collect()} == {("the", 300), ("3", 43)}


def test_a_search_takes_more_tasks_with_more_to_sum(spark, tmp_path, monkeypatch):
    """What a task of a search sums doesn't grow with documents and questions, and postings travel once, by their group."""
    docs = spark.createDataFrame([(i, f"common w{i % 7} rare{i}") for i in range(600)], "id long, text string")
    asked = spark.createDataFrame([(q, f"common w{q} rare{q * 9}") for q in range(5)], "query_id long, question string")
    index = KeptIndex(spark, str(tmp_path / "index"))
    index.upsert(docs, "id", "text")
    want = sorted(map(tuple, index.search(asked, k=7).collect()))
    monkeypatch.setattr(kept_index, "PAIRS", 100)
    plan = index.plan(asked, 1)[1]._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Generate explode(postings")
    assert "Exchange" not in above and below.count(", 30), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in below.split("FileScan")[0]
    assert sorted(map(tuple, index.search(asked, k=7).collect())) == want
    # so does the sort of a segment's postings
    monkeypatch.setattr(kept_index, "TASK_WORDS", 180)
    other = KeptIndex(spark, str(tmp_path / "other"))
    other.upsert(docs, "id", "text")
    written = {p.name.split("-")[1] for p in (tmp_path / "other").rglob("postings/folder=*/*.parquet")}
    assert 4 < len(written) <= 10 and sorted(map(tuple, other.search(asked, k=7).collect())) == want


def test_texts_that_lie_together_are_cut_by_many_tasks(spark, tmp_path):
    spark.range(4000).selectExpr("id as doc_id", "repeat(sha2(cast(id as string), 256), 4) as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(800).selectExpr("id as vec_id", "array(1f) as embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    try:
        rows = catalog._index_texts(catalog.Tables(spark, str(tmp_path)))
        held = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert sum(held) == 800 and max(held) < 400


def test_only_texts_of_hits_travel(spark, tmp_path, monkeypatch):
    """Reranking reads the texts that were hit: all texts were dealt by key to meet their vectors."""
    at = str(tmp_path)
    spark.range(300).selectExpr("id as doc_id", "concat('word', id % 7, ' n', id) as text").write.parquet(f"{at}/documents.parquet")
    spark.range(200).selectExpr("id as vec_id", "array(float(id), 1f) as embedding").write.parquet(f"{at}/embeddings.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = catalog._index(catalog.Tables(spark, at))
        asked = spark.createDataFrame([(1, "word3 n3"), (2, "word5 word9")], "query_id long, question string")
        hits = spark.createDataFrame([(1, 3, 0, 1), (1, 10, 0, 2), (1, 4, 1, 1), (2, 5, 0, 1), (2, 250, 0, 2)], "query_id long, id long, source int, place int")
        got = retrieval.scored(asked, hits, index, "doc_id", "text", None)
        lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
        scan = next(n for n, x in enumerate(lines) if "FileScan" in x and "text#" in x)
        above = next(n for n in range(scan, -1, -1) if "Exchange hashpartitioning" in lines[n])
        assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in lines[above:scan])
        want = [(1, 3, 1.0), (1, 4, 0.0), (1, 10, 0.5), (2, 5, 0.5)]
        assert sorted((r["query_id"], r["id"], r["judged"]) for r in got.collect()) == want
        monkeypatch.setattr(retrieval, "SENT_HITS", 2)
        own = retrieval.scored(asked, hits, index, "doc_id", "text", retrieval.word_overlap(F.col("question"), F.col("text")))
        assert sorted((r["query_id"], r["id"], r["judged"]) for r in own.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_lie_where_their_texts_do(spark, tmp_path, monkeypatch):
    """Each task sorts and writes the postings of its own lists: all were dealt by term first. Lists stay in a merge, too."""
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("r"), "id")).alias("text")).repartition(3)
    was = spark.conf.get(kept_index.OPEN_FILES)
    monkeypatch.setattr(kept_index, "TASK_WORDS", 150)
    found = []
    for sent in (200_000, 0):
        monkeypatch.setattr(kept_index, "SENT_ROWS", sent)
        index = KeptIndex(spark, str(tmp_path / f"i{sent}"))
        index.upsert(docs, "id", "text")
        at = tmp_path / f"i{sent}/segments/{index.snapshot().segments[0]['name']}"
        lists = len(list((at / "forward").glob("*.parquet")))
        files = [pq.read_table(str(p), partitioning=None).to_pylist() for p in (at / "postings").rglob("folder=*/*.parquet")]
        assert lists == 3 and len([1 for rows in files if any(r["term"] == "the" for r in rows)]) == 3
        for rows in files:
            # 50 documents or more of three words each are sorted at a time
            order = [(r["term"], r["grp"]) for r in rows]
            assert len([1 for a, b in zip(order[:-1], order[1:]) if b < a]) <= 2
        index.upsert(docs.where("id < 90").withColumn("text", F.lit("the other")), "id", "text")
        index.delete(docs.where("id % 10 = 3"), "id")
        assert index.merge(fanout=2) and index.size() == (270, 81 * 2 + 189 * 3)
        asked = spark.createDataFrame([("the",), ("other",), ("w3",), ("r4",), ("r94",)], "term string")
        found.append(sorted(map(tuple, index.frequencies(asked).collect())))
    assert found[0] == found[1] == sorted([("the", 270), ("other", 81), ("r94", 1), ("w3", len([i for i in range(90, 300) if i % 7 == 3 and i % 10 != 3]))])
    assert spark.conf.get(kept_index.OPEN_FILES) == was
