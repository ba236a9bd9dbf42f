"""Whole ingestion plans on small literals; retrieval parts against plain Python."""

import json
import random

from pyspark.sql import functions as F

from strataloom.functions.providers import Providers
from strataloom.operators import graph, pipelines, projects, retrieval
from strataloom.plans import catalog

TTP = {"technique_id": "T1", "name": "x", "chunk_number": 0, "relevance": 0.95, "have_code": True}


def analysis(spark, tmp_path):
    files = [
        {
            "file_name": "a.py",
            "chunks": [
                {"chunk_number": 0, "code": "run()", "start_line": 1, "end_line": 1},
                {"chunk_number": 1, "code": "low()", "start_line": 2, "end_line": 2},
                {"chunk_number": 2, "code": " 　", "start_line": 3, "end_line": 3},
            ],
            "file_technique": {"result": True, "status": "success", "ttps": [{**TTP, "relevance": 0.1}, TTP, {**TTP, "chunk_number": 1, "relevance": None}]},
        },
        {"file_name": "b.py", "chunks": [{"chunk_number": 0, "code": "x", "start_line": 1, "end_line": 1}], "file_technique": {"result": True, "status": "failed", "ttps": [TTP]}},
        {"file_name": "c.py"},
    ]
    rows = [{"software_name": "p", "software_summary": "s", "software_tactics": {"tactics": [{"tactic_id": "TA1"}]}, "software_files": files}, {"software_name": "empty"}]
    path = tmp_path / "r.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    return spark.read.schema(pipelines.ANALYSIS).json(str(path))


def test_analysis_tables(spark, tmp_path):
    out = pipelines.analysis_tables(analysis(spark, tmp_path), 3, F.upper)
    assert {(r["name"], tuple(r["tactic_id_list"]), r["insert_number"]) for r in out["software"].collect()} == {("p", ("TA1",), 3), ("empty", (), 3)}
    assert sorted(r["name"] for r in out["file"].collect()) == ["a.py", "b.py", "c.py"]
    chunks = {r["code_data"]: r for r in out["code_chunk"].collect()}
    assert {k: (r["class"], r["technique_id"], r["have_code"], r["description"]) for k, r in chunks.items()} == {
        "run()": ("accepted", "T1", True, "RUN()"), "low()": ("low", "T1", True, None), "x": ("none", None, False, None),
    }
    edges = [tuple(r) for r in out["edges"].collect()]
    kinds = [e[2] for e in edges]
    assert {k: kinds.count(k) for k in kinds} == {"HAS_FILE": 3, "FILE_OF": 3, "HAS_CHUNK": 3, "CHUNK_OF": 3, "HAS_LABEL": 1, "LABEL_OF": 1}
    assert (chunks["run()"]["code_uuid"], "T1", "HAS_LABEL") in edges
    again = pipelines.analysis_tables(analysis(spark, tmp_path))
    assert {r["code_uuid"] for r in again["code_chunk"].collect()} == {r["code_uuid"] for r in chunks.values()}


def test_document_tables(spark):
    rows = [("d", 1, "B", "text", None), ("d", 0, "A", "text", None), ("d", 2, "img", "image", 0), ("d", 3, "C", "image", None), ("e", 0, None, None, None)]
    parsed = spark.createDataFrame(rows, "name string, chunk_number int, content string, chunk_type string, safe_sign int")

    def label(text):
        return [{"label_id": "T" + text, "relevance": 0.9, "evidence": "e"}, {"label_id": "low", "relevance": 0.5, "evidence": "e"}]

    p = Providers(label=label, describe=lambda t: t[:1])
    out = pipelines.document_tables(parsed, p.labels, p.description, window=2)
    docs = {r["name"]: r for r in out["document"].collect()}
    assert docs["d"]["full_text"] == "ABC" and docs["d"]["label_ids"] == ["TAB", "TC"] and docs["d"]["article_summary"] == "A"
    assert docs["e"]["full_text"] == "" and docs["e"]["label_ids"] == []
    assert out["document_chunk"].count() == 4
    assert out["edges"].where("type = 'HAS_LABEL'").count() == 2


def test_url_backfill(spark):
    owners = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q")], "owner_id int, name string")
    files = spark.createDataFrame([(1, "a b.py", None), (1, "z.py", "old"), (2, "a.py", None)], "owner_id int, name string, repo_url string")
    urls = spark.createDataFrame([("p", "http://h/p/"), ("q", "http://h/q")], "name string, url string")
    paths = spark.createDataFrame([("p", "src/a b.py"), ("p", "x/a b.py"), ("q", "a.py")], "name string, path string")
    out, shared = pipelines.backfill_urls(owners, files, urls, paths, "owner_id")
    assert {(r["owner_id"], r["name"], r["repo_url"]) for r in out.collect()} == {
        (1, "a b.py", "http://h/p/src/branch/main/src/a%20b.py"), (1, "z.py", "old"), (2, "a.py", None),
    }
    assert [tuple(r) for r in shared.collect()] == [("q", 2)]


def test_vector_backfill_asks_only_for_what_lacks_one(spark):
    rows = spark.createDataFrame([("a", [1.0]), ("b", None), (None, None)], "text string, vector array<double>")
    p = Providers(embed=lambda t: [9.0] if t == "b" else [0.0])
    assert sorted(map(str, (r["vector"] for r in pipelines.backfill_vectors(rows, "text", "vector", p.embedding).collect()))) == ["None", "[1.0]", "[9.0]"]


def test_two_hops_of_queries_are_apart(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("b", "a", "t"), ("c", "d", "t")], "src string, dst string, type string")
    roots = spark.createDataFrame([(1, 0, "a"), (2, 0, "c"), (3, 0, "a")], "query_id int, i int, id string")
    out = graph.two_hops(roots, edges, ["query_id"])
    got = {(r["query_id"], r["level"], r["id"]) for r in out.collect()}
    assert got == {(1, 1, "b"), (1, 2, "c"), (2, 1, "d"), (3, 1, "b"), (3, 2, "c")}


def test_cells(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    model = retrieval.cells(table, "embedding", 8)
    placed = retrieval.assigned(model, table, "embedding")
    key = lambda d: {(r["query_id"], r["id"], r["score"]) for r in d.collect()}
    exact = key(retrieval.nearest(queries, table, "vec_id", "embedding"))
    assert key(retrieval.nearest_in_cells(model, placed, queries, "vec_id", "embedding", 8)) == exact
    assert len(key(retrieval.nearest_in_cells(model, placed, queries, "vec_id", "embedding", 4)) & exact) >= 0.6 * len(exact)


def test_cells_reach_the_recall_they_promise(spark):
    t = catalog.Tables(spark, "/root/testdata/sf0.001")
    key = lambda d: {(r["query_id"], r["id"], r["score"]) for r in d.collect()}
    exact = key(retrieval.nearest(catalog._questions(t), catalog._index(t), "doc_id", "embedding"))
    assert exact and len(key(catalog.cells_top(t)) & exact) >= 0.9 * len(exact)


def test_findings_without_a_chunk_are_told(spark, tmp_path):
    out = pipelines.unmatched_findings(analysis(spark, tmp_path))
    assert out.count() == 0  # each names a chunk of its file
    files = [
        {"file_name": "a.py", "chunks": [{"chunk_number": 0, "code": "x"}, {"chunk_number": 1, "code": " "}],
         "file_technique": {"ttps": [TTP, {**TTP, "chunk_number": 1}, {**TTP, "chunk_number": 7}, {**TTP, "chunk_number": 7}, {**TTP, "chunk_number": None}]}},
        {"file_name": "b.py", "file_technique": {"ttps": [TTP]}},
    ]
    path = tmp_path / "lost.json"
    path.write_text(json.dumps({"software_name": "p", "software_files": files}) + "\n" + json.dumps({"software_name": "none"}))
    got = pipelines.unmatched_findings(spark.read.schema(pipelines.ANALYSIS).json(str(path)))
    assert {(r["file_name"], r["chunk_number"], r["n"]) for r in got.collect()} == {("a.py", 1, 1), ("a.py", 7, 2), ("a.py", None, 1), ("b.py", 0, 1)}


def test_groups_in_order_of_first_sight(spark):
    rows = [(1, "b", 5, "x"), (1, "a", 7, "y"), (1, None, 6, "z"), (1, "a", 9, "w"), (1, "a", 9, "y"), (2, "a", 3, "q"), (2, None, 3, None)]
    table = spark.createDataFrame(rows, "own int, grp string, at int, name string")
    out = graph.groups_in_order(table, ["own"], "grp", "at", "name")
    got = {(r["own"], r["pos"]): (r["grp"], r["items"]) for r in out.collect()}
    assert got == {(1, 1): ("b", ["x"]), (1, 2): (None, ["z"]), (1, 3): ("a", ["w", "y"]), (2, 1): (None, []), (2, 2): ("a", ["q"])}
    assert graph.groups_in_order(table.limit(0), ["own"], "grp", "at", "name").count() == 0


def test_suggested_files_exist_and_keep_their_order(spark):
    rows = [("p", "a/b/c.py"), ("p", "z.py"), ("p", "a.py"), ("p", "a.py"), ("q", "m.py"), ("r", "main.py"), ("s", "x.py")]
    files = spark.createDataFrame(rows, "project string, relative_path string")

    def ask(prompt):
        told = json.loads(prompt.split("\n", 1)[1])
        if told["software_name"] == "q":
            return '```json\n{"main_files": []}\n```'
        if told["software_name"] == "r":
            raise OSError("no model")
        if told["software_name"] == "s":
            return '{"main_files": "x.py"}'
        assert told["files"][:2] == ["a.py", "z.py"]
        return json.dumps({"main_files": ["z.py", "gone.py", "a.py"]})

    out = projects.suggested_files(files.distinct(), Providers(ask=ask), 2)
    assert {r["project"]: r["names"] for r in out.collect()} == {"p": ["z.py", "a.py"], "q": [], "r": [], "s": []}
    chosen = projects.main_files(files, out)
    assert {r["project"]: r["main_files"] for r in chosen.collect()} == {"p": ["z.py", "a.py"], "q": [], "r": ["main.py"], "s": []}


def test_ingestion_queries_are_not_empty(spark):
    """Every class, type and choice that the ingestion queries tell apart is met."""
    rows = lambda name: catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert {r[0] for r in rows("analysed_chunks").select("class").distinct().collect()} == {"none", "low", "accepted"}
    assert {r[0] for r in rows("analysed_edges").select("type").distinct().collect()} == {"HAS_FILE", "FILE_OF", "HAS_CHUNK", "CHUNK_OF", "HAS_LABEL", "LABEL_OF"}
    urls = rows("urls_backfilled").select("repo_url")
    assert urls.where("repo_url is null").count() and urls.where("repo_url = 'old'").count() and urls.where("repo_url like '%20%'").count()
    mains = rows("main_files_chosen")
    assert mains.where("main_files like '%/%'").count() and mains.where("main_files like 'main_%'").count()


def test_a_second_hop_is_dealt_once_by_its_roots(spark):
    """Nodes ahead travel as lists to their root set, and no row of the second level does: it went through three shuffles."""
    r = random.Random(4)
    edges = [(f"n{r.randint(0, 30)}", f"n{r.randint(0, 30)}", r.choice("AB")) for _ in range(150)] + [("n1", None, "A"), ("n2", "n3", None)]
    roots = [(q, i, f"n{r.randint(0, 30)}") for q in range(12) for i in range(2)] + [(None, 0, "n5")]
    a, e = spark.createDataFrame(roots, "q int, i int, id string"), spark.createDataFrame(edges, "src string, dst string, type string")
    out = graph.two_hops(a, e, ["q"])
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(q#" in line]
    assert any("REPARTITION_BY_COL" in line for line in dealt) and not any("dst#" in line.split("hashpartitioning(")[1].split(", [")[0].split("id#")[0] for line in dealt if "REPARTITION" in line)
    order = lambda x: (x[0] is not None, x[0] or "")
    want = []
    for q in {x[0] for x in roots}:
        own = [(i, n) for p, i, n in roots if p == q]
        hop = lambda n: sorted(((t, d) for s, d, t in edges if s == n), key=lambda x: (order((x[0],)), order((x[1],))))  # noqa: E731, B023
        one = [(i, j, d, t) for i, n in own for j, (t, d) in enumerate(hop(n))]
        want += [(q, 1, i, j, 0, d, t) for i, j, d, t in one]
        met, taken = {}, set()
        for i, j, d, _ in sorted(one, key=lambda x: x[:2]):
            met.setdefault(d, (i, j))
        for i, j, d, _ in sorted(one, key=lambda x: x[:2]):
            for k, (t, far) in enumerate(hop(d) if d is not None else []):
                blocked = far is not None and q is not None and (far in {n for _, n in own} or (far in met and met[far] <= (i, j)))
                if far not in taken and not blocked:
                    taken.add(far)
                    want.append((q, 2, i, j, k, far, t))
    key = lambda x: tuple(order((v if isinstance(v, str) else None if v is None else f"{v:06d}",)) for v in x)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_ends_of_one_kind_travel_as_numbers(spark):
    """A list of ends that are a word and a number each is dealt as numbers; other texts, of any form, stay as they are."""
    odd = ["x7", "x07", "x1234567890", "x", "", "7", "0", "x1\n", "y-3", "x2y3", None]
    edges = [("r", "a", "t"), ("r", "b", "t"), *[("a", f"n{i}", "t") for i in (0, 5, 10, 123456789)], *[("b", x, "t") for x in odd], *[("b", x, "u") for x in ("7", "0", "n5")]]
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    roots = spark.createDataFrame([(1, 0, "r")], "q int, i int, id string")
    out = graph.two_hops(roots, e, ["q"])
    got = [(r["j"], r["k"], r["id"], r["type"]) for r in out.where("level = 2").collect()]
    near = sorted([x for s, x, _ in edges if s == "a"])
    far = sorted(odd, key=lambda x: (x is not None, x or ""))
    assert sorted(got, key=lambda r: r[:2]) == [(0, k, x, "t") for k, x in enumerate(near)] + [(1, k, x, "t") for k, x in enumerate(far)]
    dealt = []
    plan = out._jdf.queryExecution().optimizedPlan()
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "RepartitionByExpression":
            dealt += [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
        stack += [node.children().apply(i) for i in range(node.children().size())]
    assert "array<int>" in dealt
