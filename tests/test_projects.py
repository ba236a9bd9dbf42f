"""From folders to the base, on small projects; scanners of source code; small lookups."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.functions import chunking, providers, text, units
from strataloom.functions.providers import Providers
from strataloom.operators import graph, ingest, lookup, matching, packing, pipelines, projects, retrieval
from strataloom.settings import Settings
from strataloom.sources import files as sources
from strataloom.streaming import jobs

SAMPLES = {
    "javascript": (
        'import x from "y";\nexport default class A extends B {\n  constructor(a) { this.a = "}"; }\n  async run(b) {\n    if (b) { return 1; }\n  }\n}\n'
        "function* gen(a) { yield a }\nconst f = async (x) => {\n  return x;\n};\nconst g = y => y + 1;\nexport { A, f };\n",
        [(2, 7), (3, 3), (4, 6), (8, 8), (9, 11), (12, 12), (13, 13)],
    ),
    "typescript": ("interface P { a: string; }\ntype Q = { b: number } | null;\nexport function h<T>(x: T): T { return x; }\n", [(1, 1), (2, 2), (3, 3)]),
    "java": (
        "package a;\n// class Fake {\npublic class A<T> implements C {\n  private int x = f(1);\n  public A(int x) { this.x = x; }\n  @Override\n"
        "  public <S> List<S> go(Map<String, S> m) throws E { for (int i : m) { call(i); } return null; }\n  interface I { void m(int a); }\n}\n",
        [(3, 9), (5, 5), (7, 7), (8, 8)],
    ),
    "cpp": (
        "#include <x>\nusing namespace std;\nint total = 3;\nint add(int a, int b);\nnamespace n {\nclass A { int f() const { int y = 2; return y; } };\ndouble z[2] = {1, 2};\n}\n"
        "int main(int argc, char** argv) {\n  int q = 1;\n  if (q) { return 0; }\n  return 1;\n}\n",
        [(3, 3), (4, 4), (5, 8), (6, 6), (7, 7), (9, 13)],
    ),
    "go": ('package main\ntype T struct { a int }\nvar x = 3\nconst (\n  a = 1\n)\nfunc (t *T) M(a int) (int, error) {\n  return a, nil\n}\nfunc main() { p("}") }\n', [(2, 2), (3, 3), (4, 6), (7, 9), (10, 10)]),
    "rust": (
        "use std::x;\npub struct A<'a> { b: &'a str }\nstruct U;\nimpl<'a> A<'a> {\n    pub fn f(&self) -> u8 { b'}' }\n}\ntrait T { fn g(&self); }\nmod m { pub enum E { A } }\n",
        [(2, 2), (3, 3), (4, 6), (5, 5), (7, 7), (8, 8)],
    ),
    "csharp": (
        "namespace N {\n  public class A : B {\n    public int X { get; set; }\n    public async Task<int> Run(int a) { return a; }\n    int Short(int a) => a + 1;\n    enum E { P, Q }\n  }\n}\n",
        [(2, 7), (4, 4), (5, 5), (6, 6)],
    ),
    "scala": ("package p\ncase class A(x: Int)\nclass B extends C {\n  def f(x: Int): Int = { x + 1 }\n  def g(y: Int) = y\n}\ntrait T\n", [(2, 2), (3, 6), (4, 4), (5, 5), (7, 7)]),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_units(language):
    code, want = SAMPLES[language]
    found = units.unit_lines(code, language)
    assert [(a, b) for a, b, _ in found] == want
    lines = code.split("\n")
    for a, b, part in found:
        assert "\n".join(lines[a - 1 : b]).find(part) >= 0
    assert chunking.split_code(code, language) == found
    for broken in (code[: len(code) // 2], code.replace("}", ""), code.replace("{", ""), "", "{{{", '"'):
        assert units.unit_lines(broken, language)


def test_code_outside_of_units():
    code = "import a\nimport b\n\n# note\nX = 1\ndef f():\n    return 1\nrun()\n"
    assert chunking.not_in_units(code, "python") == [(1, 2, "import a\nimport b"), (5, 5, "X = 1"), (8, 8, "run()")]
    assert chunking.not_in_units("x = 1\ny = 2", "python") == [(1, 2, "x = 1\ny = 2")] and chunking.not_in_units("a", "markdown") == []
    assert chunking.not_in_units(SAMPLES["go"][0], "go") == [(1, 1, "package main")]


def test_separators_of_a_language():
    body = "".join(f"\n## Part {k}\n" + f"line {k} of it. " * 30 for k in range(8))
    parts = chunking.by_separators("# Title\n" + body, "md", 900, 50)
    assert all(len(p) <= 900 for _, _, p in parts) and all(p.lstrip().startswith("#") for _, _, p in parts)
    assert "".join(p for _, _, p in parts) == "# Title\n" + body
    assert [a for a, _, _ in parts] == sorted(a for a, _, _ in parts)
    plain = chunking.by_separators("word " * 1000, None, 500, 50)
    assert all(len(p) <= 500 for _, _, p in plain) and len(plain) > 8


def test_a_file_that_fails_keeps_a_row(spark):
    def splitter(code, language):
        if "bad" in code:
            raise ValueError("can't")
        return chunking.split_code(code, language)

    rows = spark.createDataFrame([("a", "good = 1", "python"), ("b", "bad", "python"), ("c", " ", "python"), ("d", None, None)], "path string, content string, language string")
    got = {r["path"]: r for r in chunking.chunk_files(rows, splitter=splitter, keep_failed=True).collect()}
    assert got["a"]["status"] == "success" and got["a"]["chunk"] == "good = 1" and set(got) == {"a", "b"}
    assert (got["b"]["status"], got["b"]["error"], got["b"]["chunk"], got["b"]["chunk_number"]) == ("failed", "ValueError: can't", None, None)
    with pytest.raises(Exception):
        chunking.chunk_files(rows, splitter=splitter).collect()


def _project(spark, root):
    for path, body in {
        "one/README.md": "About one.", "one/main.py": "def start():\n    beacon()\n\ndef stop():\n    pass\n", "one/src/util.go": "package u\nfunc Help() { beacon() }\n",
        "one/node_modules/x.js": "function f() {}", "one/data.bin": "x", "two/only.txt": "nothing",
    }.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body)
    files = sources.scan_all(spark, str(root), content=True)
    parts = F.split("relative_path", "/", 2)
    return files.select(parts[0].alias("project"), parts[1].alias("relative_path"), "name", "length", "content")


def test_project_to_base(spark, tmp_path):
    files = _project(spark, tmp_path)
    replies = {"summary": json.dumps({"summary": "A tool.", "files": ["main.py"]}), "tactics": "no json"}

    def label(part):
        return [{"label_id": "T1071", "relevance": 0.95, "evidence": "beacon()"}, {"label_id": "low", "relevance": 0.2, "evidence": "x"}] if "beacon" in part else []

    p = Providers(label=label, ask=lambda q: replies[q.split("\n")[0]] if '"one"' in q else "")
    rows = {r["software_name"]: r for r in projects.analyse(files, p).collect()}
    assert rows["one"]["software_summary"] == "A tool." and rows["two"]["software_summary"] == "Code files: 0" and rows["two"]["software_files"] is None
    assert [t["tactic_id"] for t in rows["one"]["software_tactics"]["tactics"]] == ["TA0011"]
    assert rows["one"]["software_tree"].split("\n") == ["├── node_modules", "│   └── x.js", "├── src", "│   └── util.go", "├── data.bin", "├── main.py", "└── README.md"]
    found = {f["file_abs_path"]: f for f in rows["one"]["software_files"]}
    assert sorted(found) == ["main.py", "src/util.go"]
    assert [(t["technique_id"], t["chunk_number"]) for t in found["main.py"]["file_technique"]["ttps"]] == [("T1071", 0)]
    out = projects.ingest_code(files, p, 7)
    assert {r["name"] for r in out["software"].collect()} == {"one", "two"} and out["file"].count() == 2
    accepted = out["code_chunk"].where("class = 'accepted'").collect()
    assert {r["code_data"] for r in accepted} == {"def start():\n    beacon()", "func Help() { beacon() }"}
    assert {r["id"] for r in out["index"].collect()} == {r["code_uuid"] for r in accepted} and out["faults"].count() == 0
    assert {(r["project"], r["status"]) for r in out["projects"].collect()} == {("one", "success"), ("two", "skipped")}
    assert out["edges"].where("type = 'HAS_LABEL'").count() == 2
    terms = projects.terms_of(out["index"], str(tmp_path / "terms"))
    asked = spark.createDataFrame([(1, "beacon please")], "query_id int, question string")
    assert {r["id"] for r in retrieval.bm25(asked, terms).collect()} == {r["code_uuid"] for r in accepted}
    failed = projects.ingest_code(files, Providers(label=lambda part: 1 / 0))["projects"].collect()
    assert {(r["project"], r["status"], r["error"]) for r in failed} == {("one", "failed", "no file was labelled"), ("two", "skipped", None)}
    wrong = projects.ingest_code(files, p, dimension=3)
    assert wrong["index"].count() == 0 and {r["fault"] for r in wrong["faults"].collect()} == {"wrong dimension"}


def test_documents_to_base(spark):
    rows = [("d", 0, "Alpha text", "text", None), ("d", 1, "png1", "image", None), ("d", 2, "png2", "image", None), ("d", 3, "omega", "text", None), ("e", 0, "", "text", None)]
    parsed = spark.createDataFrame(rows, "name string, chunk_number int, content string, chunk_type string, safe_sign int")
    seen = []

    def slow(image):
        raise OSError(image)

    p = Providers(judge=lambda x: x == "png1", read=(slow, lambda x: " ", lambda x: f"text of {x}"), label=lambda t: [{"label_id": "T", "relevance": 1.0, "evidence": "e"}])
    read = {(r["name"], r["chunk_number"]): (r["content"], r["safe_sign"]) for r in projects.read_images(parsed, p).collect()}
    assert read[("d", 1)] == ("text of png1", 1) and read[("d", 2)] == ("png2", 0) and read[("d", 0)] == ("Alpha text", None) and not seen
    out = projects.ingest_documents(parsed, p)
    docs = {r["name"]: r for r in out["document"].collect()}
    assert docs["d"]["full_text"] == "Alpha texttext of png1omega" and docs["d"]["article_summary"] and docs["e"]["article_summary"] is None
    assert {r["fault"] for r in out["faults"].collect()} == {"no text"} and out["index"].count() == 3


def test_two_level_summaries(spark):
    texts = spark.createDataFrame([(1, "aaaabbbbcc"), (2, ""), (3, "xxxx"), (4, None)], "k int, t string")
    p = Providers(describe=lambda t: None if t == "xxxx" else t[0] + str(len(t)))
    got = {r["k"]: (r["parts"], r["summary"]) for r in projects.summaries(texts, "k", "t", p.description, 4).collect()}
    assert got == {1: (3, "a8"), 2: (0, None), 3: (0, None), 4: (0, None)}


def test_tasks_say_how_they_end(spark):
    said = {"a": '```json\n{"summary": "s", "files": [],}\n```', "b": "nothing", "c": '{"summary": "s"}', "d": ""}
    p = Providers(ask=lambda q: said[q])
    rows = spark.createDataFrame([(k,) for k in said] + [("boom",), (None,)], "q string")
    got = {r["q"]: (r["t"]["status"], r["t"]["error"]) for r in rows.select("q", p.task(F.col("q"), "summary").alias("t")).collect()}
    assert got == {"a": ("success", None), "b": ("failed", "no json"), "c": ("failed", "wrong shape"), "d": ("failed", "no reply"), "boom": ("failed", "no reply"), None: ("failed", "no reply")}
    providers.register("mine", p)
    assert providers.registered("mine") is p and providers.registered() == Providers()
    with pytest.raises(KeyError):
        providers.registered("none")
    one = spark.range(1).select(projects.technique_prompt(F.lit("n"), F.lit("s"), F.lit("t"), F.expr("array(named_struct('chunk_number', 1, 'code', repeat('x', 6000)))")).alias("p")).first()["p"]
    body = json.loads(one.split("\n", 1)[1])
    assert one.startswith("techniques\n") and len(body["chunks"][0]["code"]) == 5003 and body["software_name"] == "n"


def test_url_backfill_of_documents(spark):
    docs = spark.createDataFrame([("a", None), ("b", "old"), ("c", None), ("c", None)], "name string, repo_url string")
    chunks = spark.createDataFrame([("a1", "a", None), ("b1", "b", "old"), ("c1", "c", None)], "chunk_id string, name string, repo_url string")
    index = spark.createDataFrame([("a1", None), ("b1", None), ("c1", "x")], "id string, url string")
    urls = spark.createDataFrame([("a", "http://a"), ("c", "http://c")], "name string, url string")
    d, c, i, shared = projects.backfill_document_urls(docs, chunks, index, urls)
    assert sorted((r["name"], r["repo_url"] or "") for r in d.collect()) == [("a", "http://a"), ("b", "old"), ("c", ""), ("c", "")]
    assert {r["chunk_id"]: r["repo_url"] for r in c.collect()} == {"a1": "http://a", "b1": "old", "c1": None}
    assert {r["id"]: r["url"] for r in i.collect()} == {"a1": "http://a", "b1": None, "c1": "x"} and [tuple(r) for r in shared.collect()] == [("c", 2)]


def test_parsed_json_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("f", 0, "A", None, "1", 0, "text"), ("f", 1, "img", 1, "2", 1, "image"), ("f", 2, "bad", 0, "3", 2, "image")],
        "file string, pos int, content string, safe_sign int, chunk_id string, chunk_number int, chunk_type string")
    (tmp_path / "f.json").write_text(projects.parsed_json(chunks).first()["json"])
    got = sources.parsed_chunks(spark, str(tmp_path / "f.json")).orderBy("pos").collect()
    assert [(r["content"], r["safe_sign"], r["chunk_number"]) for r in got] == [("A", None, 0), ("img", 1, 1)]


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.py", "b.pdf", "sub/c.md", "README.txt"):
        (tmp_path / "in" / name).write_text("x" + name)
    flat = sources.scan(spark, str(tmp_path / "in"), recursive=False, content=True)
    assert {r["name"] for r in flat.collect()} == {"a.py", "b.pdf", "README.txt"}
    ok = {r["name"]: r["accepted"] for r in sources.allowed(flat, sources.DOCUMENTS).collect()}
    assert ok == {"a.py": False, "b.pdf": True, "README.txt": True}
    assert sources.allowed(flat, sources.ARCHIVES).where("accepted").count() == 0 and sources.allowed(flat, sources.BATCH_DOCUMENTS).where("accepted").count() == 2
    assert sources.readme(flat.withColumn("project", F.lit("p"))).first()["readme"] == "xREADME.txt"
    log = str(tmp_path / "log")
    for status in ("success", "failed"):
        sources.append_processed(spark.createDataFrame([(f"{status}.pdf", status)], "name string, status string"), log)
    assert [r["name"] for r in sources.processed_log(spark, log).collect()] == ["success.pdf"]
    rows = spark.createDataFrame([("naïve, \"x\"", 1)], "a string, b int")
    sources.write_json(rows, str(tmp_path / "j"))
    sources.write_csv(rows, str(tmp_path / "c"))
    sources.write_text(rows, "a", str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).first()["a"] == 'naïve, "x"' and spark.read.text(str(tmp_path / "t")).first()[0] == 'naïve, "x"'
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["b"] == "1"


def test_copy_modes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    got = {m: sorted(map(tuple, ingest.copy_collection(new, old, m, ["k"], [F.col("v")]).collect())) for m in ("insert", "upsert", "recreate", "dry-run")}
    assert got["insert"] == [(1, "a"), (2, "b"), (2, "c"), (3, "d")] and got["upsert"] == [(1, "a"), (2, "c"), (3, "d")]
    assert got["recreate"] == [(2, "c"), (3, "d")] and got["dry-run"] == [(1, "a"), (2, "b")]


def test_labels_and_fields(spark):
    rows = spark.createDataFrame([(["Base", "file", "code"], {"a": "1", "b": "2"}), (["Base"], {"a": "1"})], "labels array<string>, props map<string,string>")
    last, first = graph.domain_label(F.col("labels"), "Base"), graph.domain_label(F.col("labels"), "Base", last=False)
    got = rows.select(last.alias("l"), first.alias("f"), graph.kept_fields(F.col("props"), last, {"code": ("b",)}).alias("p")).collect()
    assert [(r["l"], r["f"], r["p"]) for r in got] == [("code", "file", {"b": "2"}), ("Base", "Base", {"a": "1"})]


def test_text_helpers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(text.shorten_middle(F.lit("abcdefghij"), 4, "~")) == "ab~ij" and get(text.shorten(F.lit("abcdef"), 4)) == "abcd..." and get(text.shorten(F.lit("abc"), 4)) == "abc"
    assert get(text.folder_of(F.lit("/base/x"), "/base")) == "/base/x" and get(text.folder_of(F.lit("/else/y/"), "/base")) == "/base/y"
    for reply, want in (('["a", {"text": "b"}]', "a\nb"), ('{"lines": ["c", "d"]}', "c\nd"), ('{"text": "e"}', "e"), ('"plain"', "plain"), ("plain", "plain"), ("[]", None), (" ", None)):
        assert get(text.lines_of(F.lit(reply))) == want
    assert get(text.words(F.lit("Abc 中文字 d漢 e"))) == ["abc", "d", "e", "中文", "文字", "漢"]
    assert get(text.line_of(F.lit("a\nb\nc"), F.lit("c"))) == 3 and get(text.line_of(F.lit("a"), F.lit("z"))) == 1
    assert get(text.is_main_name(F.lit("src/Main.py"))) and not get(text.is_main_name(F.lit("x/util.py")))
    stamp = F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert get(text.time_suffix(stamp)) == "20240102030405" and get(text.iso(stamp, "timestamp")) == "2024-01-02T03:04:05.000000"
    huge = get(text.cosine(F.array(F.lit(1e200), F.lit(1e200)), F.array(F.lit(1e-200), F.lit(1e-200))))
    assert huge == pytest.approx(1) and get(text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "b", None), (3, "a", [2.0])], "id int, t string, v array<double>")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id int")
    assert [r["id"] for r in lookup.by_ids(rows, ids, "id", "v").collect()] == [1]
    assert lookup.first_with(rows, "t", "a", "id").first()["id"] == 1 and lookup.first_with(rows, "t", "", "id").count() == 0 and lookup.first_with(rows, "t", None, "id").count() == 0
    hit = spark.sql("select named_struct('url', null, 'text', 'x') as entity, named_struct('url', 'u', 'text', 'y') as fields")
    assert hit.select(lookup.flattened("url", "entity", "fields"), lookup.flattened("text", "entity", "fields")).first() == ("u", "x")
    files = spark.sql("select 'code' as file_type, array(1) as chunks union all select 'code', array() union all select 'doc', array(1) union all select 'code', null")
    assert lookup.labelled_files(files).count() == 1


def test_suggested_paths(spark):
    files = spark.createDataFrame([("p", "/r/a.py", "a.py"), ("p", "/s/b.py", "b.py"), ("p", "/x.py", "x.py")], "project string, path string, name string")
    asked = spark.createDataFrame([("p", k, x) for k, x in enumerate(("/x.py", "none.py", "a.py", "/b.py", "dir/b.py"))], "project string, n int, item string")
    got = lookup.existing_paths(asked, files, ["/r", "/s/"], ["project"])
    assert [r["path"] for r in got.orderBy("n").collect()] == ["/x.py", "/r/a.py", "/s/b.py"]
    assert lookup.existing_paths(asked, files, ["/r", "/s/"], ["project"], 2).count() == 2
    assert [r["name"] for r in lookup.known_files(asked, files, ["project"]).orderBy("n").collect()] == ["x.py", "a.py", "b.py", "b.py"]


def test_counts_of_what_is_left_out(spark):
    files = spark.createDataFrame([("a.py",), ("node_modules/x/y.js",), ("src/node_modules/z.js",), (".gitignore",), ("build/.gitignore",), ("src/b.xyz",)], "relative string")
    assert tuple(lookup.ignored_counts(files).first()) == (6, 3, 1, 3)
    gap = {(r["extension"], r["missing"]) for r in lookup.extension_gap(files, (".py", ".js", ".go")).collect()}
    assert gap == {(".xyz", "list"), (".gitignore", "list"), (".go", "files")}
    runs = spark.createDataFrame([("a", "success"), ("a", "failed"), ("b", None)], "k string, status string")
    assert {tuple(r) for r in lookup.status_counts(runs, ["k"]).collect()} == {("a", 1, 1, 2), ("b", 0, 1, 1)} and tuple(lookup.status_counts(runs, []).first()) == (1, 2, 3)
    tries = spark.createDataFrame([("i", 0, "u", "p"), ("i", 1, "v", "p"), ("i", 2, "u", "p")], "k string, n int, url string, payload string")
    assert [r["n"] for r in lookup.distinct_attempts(tries, ["k"], "n", ["url", "payload"]).orderBy("n").collect()] == [0, 1]


def test_packing_in_order(spark):
    rows = spark.createDataFrame([("a", 0, 60), ("a", 1, 50), ("a", 2, 300), ("a", 3, None), ("b", 0, 10), (None, 0, 5), (None, 1, 200)], "k string, n int, s int")
    got = {(r["k"], r["n"]): r["batch"] for r in packing.greedy_batches(rows, ["k"], "n", "s", 100).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("b", 0): 0, (None, 0): 0, (None, 1): 1}
    parts = spark.createDataFrame([("a", "x" * 30), ("a", "y" * 10), ("b", "z" * 9)], "k string, t string")
    assert sorted(len(r["t"]) for r in packing.fitted(parts, ["k"], "t", 20).collect()) == [5, 9, 15]


def test_numbers_over_ranges(spark):
    rows = spark.createDataFrame([(x,) for x in [5, 3, None, 3, 9, 1, None, 7] * 50], "v int")
    got = matching.numbered(rows, "v", 7).toPandas().sort_values("number")
    assert got["number"].tolist() == list(range(400)) and got["v"].fillna(-1).is_monotonic_increasing
    assert matching.numbered(rows.limit(0), "v").count() == 0


def test_routes_positions_and_questions(spark):
    asked = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0]), (3, "c", [3.0])], "query_id int, question string, vector array<double>")
    way = lambda name: lambda q: q.select("query_id", F.lit(1).alias("rank"), F.concat(F.lit(name), "question").alias("id"), F.lit(0.5).alias("score"))
    route = F.when(F.col("query_id") == 1, "x").when(F.col("query_id") == 2, "unknown")
    got = {r["query_id"]: (r["route"], r["id"]) for r in retrieval.routed(asked, route, {"x": way("x"), "y": way("y")}, "y").collect()}
    assert got == {1: ("x", "xa"), 2: ("y", "yb"), 3: ("y", "yc")}
    hits = spark.createDataFrame([(1, k, f"h{k}") for k in range(3)], "query_id int, place int, id string")
    places = spark.createDataFrame([(1, [2, 7, 0])], "query_id int, places array<int>")
    assert [(r["rank"], r["id"]) for r in retrieval.by_position(hits, places).orderBy("rank").collect()] == [(1, "h2"), (2, "h0")]
    p = Providers(expand=lambda q: {"a": "long a", "b": " "}.get(q, q), embed=lambda t: [float(len(t))])
    told = {r["query_id"]: (r["question"], r["vector"]) for r in retrieval.expanded_questions(asked, p.expansion, p.embedding).collect()}
    assert told == {1: ("long a", [6.0]), 2: ("b", [2.0]), 3: ("c", [3.0])}
    assert {r[0] for r in asked.select(Providers(route=lambda q: "x" if q == "a" else None).strategy(F.col("question"))).collect()} == {"x", None}


def test_expansion_opens_wholes_in_both_rounds(spark):
    edges = spark.createDataFrame([("r", "F1", "t"), ("r", "n", "t"), ("p1", "F2", "t"), ("n", "p2", "t"), ("n", "m", "t"), ("p2", "r", "t")], "src string, dst string, type string")
    whole = spark.createDataFrame([("F1",), ("F2",), ("F3",)], "id string")
    parts = spark.createDataFrame([("F1", 1, "p1"), ("F1", 2, "p2"), ("F2", 1, "q1")], "whole_id string, ord int, part_id string")
    roots = spark.createDataFrame([(1, 0, "r"), (2, 0, "n")], "query_id int, i int, id string")
    got = sorted(tuple(r) for r in retrieval.expanded_parts(roots, edges, whole, parts, ["query_id"]).collect())
    assert got == [(1, 1, 0, 0, 0, "p1", "t"), (1, 1, 0, 1, 0, "p2", "t"), (1, 1, 0, 2, 0, "n", "t"), (1, 2, 0, 0, 0, "q1", "t"), (1, 2, 0, 2, 0, "m", "t"),
        (2, 1, 0, 0, 0, "m", "t"), (2, 1, 0, 1, 0, "p2", "t"), (2, 2, 0, 1, 0, "r", "t")]


def test_nearest_takes_odd_vectors(spark):
    index = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [None, 1.0])], "id long, v array<double>")
    asked = spark.createDataFrame([("q", [1.0, 1.0]), ("z", [0.0, 0.0])], "query_id string, vector array<double>")
    got = retrieval.nearest(asked, index, "id", "v", 2).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in got] == [("q", 1, 1.0), ("q", 2, 1.0)]
    assert retrieval.nearest(asked, index.limit(0), "id", "v").count() == 0 and retrieval.nearest(asked.limit(0), index, "id", "v").count() == 0


def test_settings():
    assert Settings.read({}) == Settings()
    got = Settings.read({"STRATALOOM_VECTOR_K": "7", "STRATALOOM_VECTOR_WEIGHT": "0.25", "STRATALOOM_ROUTE": "", "OTHER": "1"})
    assert (got.vector_k, got.vector_weight, got.route, got.text_k) == (7, 0.25, "reranked", 50)


def _stream(spark, tmp_path, batches, schema, build, mode):
    """Runs a streaming plan over files that come one after the other and returns all rows it has put out."""
    folder, name = tmp_path / "in", f"out{abs(hash(str(tmp_path)))}"
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / f"b{k}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(folder))
        q = build(source).writeStream.format("parquet" if mode == "append" else "memory").option("checkpointLocation", str(tmp_path / "cp"))
        q = q.outputMode(mode).trigger(availableNow=True)
        (q.option("path", str(tmp_path / "out")).start() if mode == "append" else q.queryName(name).start()).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_streamed_windows_drop_late_events(spark, tmp_path):
    first = [(1, "2024-01-01 00:05:00", 1, "a", 1.0), (2, "2024-01-01 00:50:00", 1, "a", 2.0), (3, "2024-01-01 05:00:00", 1, "a", 4.0)]
    late = [(4, "2024-01-01 00:10:00", 1, "a", 8.0), (5, "2024-01-01 09:00:00", 1, "a", 16.0)]
    rows = [spark.createDataFrame(x, EVENT.replace("timestamp", "string")).selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").collect() for x in (first, late, [])]
    rows[2] = rows[1][1:]
    got = _stream(spark, tmp_path, rows, EVENT, lambda s: jobs.windowed(s, "1 hour", late="10 minutes"), "append").collect()
    assert sorted((str(r["start"]), r["n"], float(r["total"])) for r in got) == [("2024-01-01 00:00:00", 2, 3.0), ("2024-01-01 05:00:00", 1, 4.0)]


def test_streamed_sessions_and_duplicates(spark, tmp_path):
    rows = [[(1, "2024-01-01 00:00:00", 1, "a", 1.0), (1, "2024-01-01 00:00:00", 1, "a", 1.0), (2, "2024-01-01 00:20:00", 1, "a", 1.0), (3, "2024-01-01 02:00:00", 1, "a", 1.0)], [(4, "2024-01-02 00:00:00", 2, "a", 1.0)], [(5, "2024-01-02 00:00:01", 3, "a", 1.0)]]
    rows = [spark.createDataFrame(x, EVENT.replace("timestamp", "string")).selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").collect() for x in rows]
    (tmp_path / "s").mkdir(), (tmp_path / "d").mkdir()
    got = _stream(spark, tmp_path / "s", rows, EVENT, lambda s: jobs.sessions(s, "30 minutes", late="1 minute"), "append").collect()
    assert sorted((str(r["start"]), r["n"]) for r in got) == [("2024-01-01 00:00:00", 3), ("2024-01-01 02:00:00", 1)]
    one = _stream(spark, tmp_path / "d", rows, EVENT, lambda s: jobs.unique_events(s, "1 hour"), "append")
    assert sorted(r["event_id"] for r in one.select("event_id").collect()) == [1, 2, 3, 4, 5]


def test_streamed_backfill(spark, tmp_path):
    schema = "id string, text string, vector array<double>"
    spark.createDataFrame([("a", "x", None), ("b", "y", [5.0]), ("c", None, None)], schema).write.parquet(str(tmp_path / "in"))
    p = Providers(embed=lambda t: [1.0])
    for _ in range(2):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.backfill_new(source, lambda rows: pipelines.backfill_vectors(rows, "text", "vector", p.embedding), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: r["vector"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": [1.0], "b": [5.0], "c": None}
