import io
import random
import shutil
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import chunking, parsing, text
from strataloom.functions.providers import Providers, first_sentences, hash_embedding
from strataloom.operators import graph, matching, packing, retrieval
from strataloom.sources import files
from strataloom.streaming import jobs


@pytest.mark.parametrize(
    "reply, want",
    [
        ('```json\n{"a": 1}\n```', '{"a":1}'),
        ('```\n{"a": 1}\n```', '{"a":1}'),
        ('so: {"a": "x}"} done', '{"a":"x}"}'),
        ('{"a": 1, /* c */ "b": [1, 2,],}', '{"a":1,"b":[1,2]}'),
        ('{"u": "http://x/y", // note\n "b": 2}', '{"u":"http://x/y","b":2}'),
        ('{"a": ', None),
        ("", None),
        (None, None),
    ],
)
def test_find_json(reply, want):
    assert parsing.find_json(reply) == want


def test_find_json_by_marker():
    assert parsing.find_json('{bad} {"x": 1, "ttps": []} {"y": 2}', "ttps") == '{"x":1,"ttps":[]}'


def test_scalar_functions(spark):
    row = spark.createDataFrame([("My Repo.v1.TAR.GZ", "a b/c*.py", "  ", "é~名.pptx")], "n string, p string, b string, d string").select(
        text.slug(F.col("n")).alias("slug"),
        text.slug(F.lit("名.md"), "fallback").alias("empty"),
        text.extension(F.col("n")).alias("ext"),
        text.encode_path(F.col("p")).alias("url"),
        text.has_text(F.col("b")).alias("has"),
        text.as_pdf_name(F.col("d")).alias("pdf"),
        text.preview(F.col("b"), 1).alias("cut"),
        text.preview(F.lit(None).cast("string"), 5).alias("none"),
        text.relative_path(F.lit("C:\\x\\y\\z.py"), F.lit("C:\\x")).alias("rel"),
        text.normal_language(F.lit("C++")).alias("lang"),
        parsing.between_braces(F.lit("x {a} y} z")).alias("span"),
        parsing.is_valid(F.lit('{"summary": "", "files": []}'), "summary").alias("valid"),
    ).first()
    assert row.asDict() == {
        "slug": "my_repo_v1", "empty": "fallback", "ext": ".tar.gz", "url": "a%20b/c%2A.py", "has": False, "pdf": "é~名.pdf", "cut": " ...",
        "none": text.NO_TEXT, "rel": "y/z.py", "lang": "cpp", "span": "{a} y}", "valid": True,
    }


def test_python_units():
    code = "import x\n\n@dec\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    assert [(a, b) for a, b, _ in chunking.python_units(code)] == [(3, 6), (5, 6), (8, 9)]
    assert chunking.python_units("not python (")[0][:2] == (1, 1)


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=200), st.integers(3, 40))
def test_line_chunks_lose_nothing(body, size):
    parts = chunking.by_lines(body, 1, size)
    assert "".join(p[2] for p in parts).replace("\n", "") == body.replace("\n", "")
    assert all(len(p[2]) <= size for p in parts)
    assert all(len(p) <= size for p in chunking.recursive(body, size, size // 4))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=12))
def test_greedy_batches(spark, sizes):
    want, batch, used = [], 0, None
    for s in sizes:
        if used is not None and used + s > 40:
            batch, used = batch + 1, s
        else:
            used = (used or 0) + s
        want.append(batch)
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "g int, o int, s int")
    got = packing.greedy_batches(rows, ["g"], "o", "s", 40).orderBy("o").collect()
    assert [r["batch"] for r in got] == want


def test_two_hops_against_a_loop(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice("xy")) for _ in range(18)})
        roots = ["n1", "n4", "n2"]
        out = lambda a: sorted(((t, d) for s, d, t in edges if s == a))
        want, met = [], set(roots)
        for i, r in enumerate(roots):
            for j, (t, d) in enumerate(out(r)):
                want.append((1, i, j, 0, d, t))
                met.add(d)
                for k, (t2, d2) in enumerate(out(d)):
                    if d2 not in met:
                        met.add(d2)
                        want.append((2, i, j, k, d2, t2))
        got = graph.two_hops(spark.createDataFrame(list(enumerate(roots)), "i int, id string"), spark.createDataFrame(edges, "src string, dst string, type string"))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_words_of_scripts_without_spaces(spark):
    """At both ends of what is told by number: radicals at U+2E80, ideographs beyond the basic plane; an unpaired sign of
    another script above it is a word as before."""
    asked = {"Ünï x1": ["ünï", "x1"], "a \u2e80\u2e81": ["a", "\u2e80\u2e81"], "\U00020000b": ["b", "\U00020000"], "かな z": ["z", "かな"], "한글 \u0e01": ["한글", "\u0e01"], "々": ["々"]}
    rows = spark.createDataFrame([(k,) for k in asked], "t string").select("t", text.words(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == {k: [x for x in v] for k, v in asked.items()}
    every = spark.range(0x80, 0x32000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert every.where(F.col("c").rlike(f"[{text._UNSPACED}]") & ~F.col("c").rlike(f"[{text._FROM}&&[{text._UNSPACED}]]")).count() == 0


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_trails_against_a_loop(spark, most):
    """Loops, edges of two types, edges that come twice, starts and ends that are none; before, the second length of trails
    looked up ends again, and every edge travelled with its hash."""
    r = random.Random(most)
    edges = [(r.randrange(9), r.randrange(9), r.choice("ab")) for _ in range(14)] + [(3, 3, "a"), (3, 3, "b"), (3, 3, "a"), (8, 8, "a"), (None, 3, "a"), (3, None, "a")]
    starts, ends = [0, 1, 3, 3, 8, 20], [2, 3, 5, 8, 8, 21]

    def walk(at, used):
        for e in set(edges) - used:
            if e[0] == at is not None:
                yield e[1]
                if len(used) + 1 < most:
                    yield from walk(e[1], used | {e})

    want = {(s, e) for s in starts for e in walk(s, frozenset()) if e in ends}
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = graph.trails(one(starts), spark.createDataFrame(edges, "src long, dst long, type string"), one(ends), most)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    if most == 2:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 2 and plan.count("Join LeftSemi") == 1


def test_scan_and_archives(spark, tmp_path):
    root = tmp_path / "build" / "proj"
    for name, body in {"a.py": b"x = 1\n", "node_modules/b.py": b"y", "sub/.git/config": b"", "sub/c.go": "语".encode("gbk"), "big.py": b"x" * (files.MAX_BYTES + 1)}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    scanned = files.scan(spark, str(root), content=True)
    kept = files.code_files(scanned)
    assert {r["relative_path"] for r in kept.collect()} == {"a.py", "sub/c.go"}
    assert {r["text"] for r in kept.select(files.decoded(F.col("content")).alias("text")).collect()} == {"x = 1\n", "语"}
    assert [r["project"] for r in files.git_projects(spark, str(root)).collect()] == ["sub"]
    assert [r["folder"] for r in files.subfolders(scanned).collect()] == ["node_modules", "sub"]
    arch = tmp_path / "arch"
    arch.mkdir()
    with zipfile.ZipFile(arch / "x.zip", "w") as z:
        z.writestr("in/one.txt", "1")
        z.writestr("../up.txt", "2")
    with tarfile.open(arch / "y.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("two.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"2"))
    (arch / "z.7z").write_bytes(b"nothing")
    got = {(r["member"], r["status"]) for r in files.archive_members(files.scan(spark, str(arch), content=True)).collect()}
    assert got == {("in/one.txt", "ok"), ("../up.txt", "unsafe"), ("two.txt", "ok"), (None, "unreadable: ValueError")}


def test_scan_of_every_file(spark, tmp_path):
    names = {"__init__.py": b"a", "_x/y/z/deep.py": b"b", ".dot/c.py": b"c", "empty.py": b"", "long.py": b"x" * 50, "build/d.py": b"d", "e f%20.py": b"e"}
    for name, body in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = files.scan_all(spark, str(tmp_path), content=True, max_bytes=40)
    rows = {r["relative_path"]: r for r in got.collect()}
    assert {k: r["length"] for k, r in rows.items()} == {k: len(v) for k, v in names.items()}
    assert {k: r["content"] and bytes(r["content"]) for k, r in rows.items()} == {k: None if len(v) > 40 else v for k, v in names.items()}
    plain = {r["relative_path"]: r for r in files.scan(spark, str(tmp_path)).where("name = 'long.py'").collect()}
    assert rows["long.py"]["modified"] == plain["long.py"]["modified"] and rows["long.py"]["path"] == plain["long.py"]["path"]
    assert {r["relative_path"] for r in files.code_files(got, hidden=False).collect()} == set(names) - {".dot/c.py", "build/d.py"}
    (tmp_path / "none").mkdir()
    assert files.scan_all(spark, f"file://{tmp_path}/none").count() == 0


def test_parsed_chunks(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"chunks_list": [{"content": "a", "metadata": {"chunk_type": "text", "chunk_number": 0}},'
        '{"content": "i", "safe_sign": 0, "metadata": {"chunk_type": "image"}}, {"content": "j", "metadata": {"chunk_type": "image"}}]}'
    )
    assert [r["content"] for r in files.parsed_chunks(spark, str(tmp_path / "d.json")).orderBy("pos").collect()] == ["a", "j"]


def test_reranking_of_a_single_hit(spark):
    hits = spark.createDataFrame([(1, 5, 0, 1, 0.5)], "query_id int, id int, source int, place int, s double")
    assert retrieval.reranked(hits, F.col("s")).count() == 1
    assert retrieval.reranked(hits, F.col("s"), drop_single=True).count() == 0


def test_providers(spark):
    assert hash_embedding("...") is None and abs(sum(x * x for x in hash_embedding("a b c")) - 1) < 1e-9
    assert first_sentences("One. Two. " + "x" * 200) == "One. Two."
    broken = Providers(describe=lambda t: 1 / 0, label=lambda t: 1 / 0)
    row = spark.createDataFrame([("x",)], "t string").select(broken.description(F.col("t")).alias("d"), broken.labels(F.col("t")).alias("l")).first()
    assert row["d"] is None and row["l"]["status"] == "failed"


def test_resumable_ingestion(spark, tmp_path):
    src, log, sink, check = (str(tmp_path / x) for x in ("src", "log", "sink", "check"))
    run = lambda rows: rows.withColumn("status", F.when(F.col("name") == "bad", "failed").otherwise("success"))
    for names in (["a", "bad"], ["a", "b"]):
        spark.createDataFrame([(n,) for n in names], "name string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("name string").parquet(src)
        jobs.ingest_new(spark, stream, "name", run, log, sink, check).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(sink).collect()) == ["a", "b"]
    # a second batch that stopped between its two writes is repeated whole
    for folder in (tmp_path / "log").glob("batch=*-1"):
        shutil.rmtree(folder)
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "check" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    jobs.ingest_new(spark, spark.readStream.schema("name string").parquet(src), "name", run, log, sink, check).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(sink).collect()) == ["a", "b"]


def test_streamed_windows(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = jobs.windowed(spark.readStream.schema(schema).parquet(src), "1 hour", late="1 hour")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == spark.read.parquet(src).count()


def test_copies_of_a_path_are_one_candidate(spark):
    """3000 copies of each of two items and paths of one base name: 36 million pairs met before."""
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, "a/x.py").otherwise("b/x.py").alias("path"))
    out = matching.resolve_paths(rows.select(F.col("path").alias("item")), rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") == 2
    assert sorted(map(tuple, out.collect())) == [("a/x.py", "a/x.py", 0), ("b/x.py", "b/x.py", 0)]
