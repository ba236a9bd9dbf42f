"""Registered queries of whole ingestion plans: analyses and parsed documents to tables and edges, back-fills, main files.

Customers, orders and lineitems stand for projects, their files and chunks; conversations for parsed documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.providers import Providers
from ..operators import graph, lookup, pipelines, projects
from .catalog import Tables, query

# --- analyses of projects ------------------------------------------------------------------------------------------------

_ID = "'{0}-' || left(sha256(concat_ws(chr(31), {1})), 32)"
_ANALYSES = f"""files AS (
  SELECT o_orderkey, 'c' || o_custkey AS software, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, 'f' || o_orderkey || '.py' AS name,
    o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS good FROM orders
), file AS (SELECT *, {_ID.format("software", "software")} AS software_uuid, {_ID.format("file", "software, i::VARCHAR, name, '/' || name")} AS file_uuid FROM files),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag) - 1 AS k,
    CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE l_returnflag || '-' || l_partkey END AS code,
    CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber + 20 ELSE l_linenumber END AS about FROM lineitem
), findings AS (
  SELECT l_orderkey, k, about, 'T' || l_partkey % 50 AS technique_id, CASE WHEN l_partkey % 7 <> 0 THEN 0.85::DOUBLE + l_discount::DOUBLE END AS relevance, l_returnflag = 'R' AS have_code
  FROM lines WHERE l_partkey % 10 <> 0
), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, about ORDER BY k DESC) AS n FROM findings) x WHERE n = 1),
chunk AS (
  SELECT {_ID.format("code", "file_uuid, l.k::VARCHAR")} AS code_uuid, file_uuid, code AS code_data, l_linenumber * 10 AS chunk_start_line, technique_id, relevance, coalesce(have_code, false) AS have_code,
    CASE WHEN technique_id IS NULL THEN 'none' WHEN have_code AND relevance >= 0.9::DOUBLE THEN 'accepted' ELSE 'low' END AS class
  FROM file JOIN lines l ON l.l_orderkey = o_orderkey LEFT JOIN last t ON good AND t.l_orderkey = l.l_orderkey AND t.about = l.l_linenumber WHERE code <> ' '
)"""


def _analyses(t: Tables) -> DataFrame:
    part, n = F.col("l_partkey"), F.col("l_linenumber")
    code = F.when(part % 17 == 0, " ").otherwise(F.concat("l_returnflag", F.lit("-"), "l_partkey"))
    about = F.when(F.col("l_suppkey") % 5 == 0, n + 20).otherwise(n)
    relevance = F.when(part % 7 != 0, F.lit(0.85) + F.col("l_discount").cast("double"))
    line = F.struct(n, part, "l_suppkey", "l_discount", "l_returnflag", code.alias("code"), about.alias("about"), relevance.alias("relevance"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    chunks = F.transform("x", lambda x: F.struct(
        x["l_linenumber"].alias("chunk_number"), x["code"], (x["l_linenumber"] * 10).alias("start_line"), (x["l_linenumber"] * 10 + 9).alias("end_line"), F.lit("python").alias("language"),
    ))
    ttps = F.transform(F.filter("x", lambda x: x["l_partkey"] % 10 != 0), lambda x: F.struct(
        F.concat(F.lit("T"), x["l_partkey"] % 50).alias("technique_id"), F.lit("").alias("name"), x["about"].alias("chunk_number"), x["relevance"], (x["l_returnflag"] == "R").alias("have_code"),
    ))
    status = F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("success").alias("status")
    about_file = F.struct((F.col("o_orderkey") % 13 != 0).alias("result"), status, F.lit("").alias("error"), ttps.alias("ttps"))
    name = F.concat(F.lit("f"), "o_orderkey", F.lit(".py"))
    file = F.struct("o_orderkey", name.alias("file_name"), F.concat(F.lit("/"), name).alias("file_abs_path"), chunks.alias("chunks"), about_file.alias("file_technique"))
    files = t.orders.join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(F.sort_array(F.collect_list(file)).alias("f"))
    # customers without orders are projects without files
    files = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment").join(files, "o_custkey", "left")
    entries = F.transform("f", lambda f: f.dropFields("o_orderkey"))
    tactics = F.when(F.col("o_custkey") % 3 == 0, F.array(F.struct(F.lit("x").alias("tactic"), F.col("c_mktsegment").alias("tactic_id"), F.lit("").alias("evidence"))))
    return files.select(
        F.concat(F.lit("c"), "o_custkey").alias("software_name"), F.lower("c_mktsegment").alias("software_summary"), F.lit("").alias("software_tree"),
        F.struct(F.lit("success").alias("status"), tactics.alias("tactics")).alias("software_tactics"), entries.alias("software_files"),
    )


@query(f"""SELECT 'c' || c_custkey AS name, {_ID.format("software", "'c' || c_custkey")} AS software_uuid, lower(c_mktsegment) AS description,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS tactics, 4 AS insert_number FROM customer""")
def analysed_owners(t: Tables) -> DataFrame:
    out = pipelines.analysis_tables(_analyses(t), 4)["software"]
    return out.select("name", "software_uuid", "description", F.array_join("tactic_id_list", ",").alias("tactics"), "insert_number")


@query(f"""WITH {_ANALYSES} SELECT code_uuid, file_uuid, code_data, chunk_start_line, technique_id, relevance, have_code, class,
  CASE WHEN class = 'accepted' THEN lower(code_data) END AS description FROM chunk""")
def analysed_chunks(t: Tables) -> DataFrame:
    out = pipelines.analysis_tables(_analyses(t), 4, F.lower)["code_chunk"]
    return out.select("code_uuid", "file_uuid", "code_data", "chunk_start_line", "technique_id", "relevance", "have_code", "class", "description")


@query(f"""WITH {_ANALYSES}, forward AS (
  SELECT software_uuid AS src, file_uuid AS dst, 'HAS_FILE' AS type, 'FILE_OF' AS back FROM file UNION ALL SELECT file_uuid, code_uuid, 'HAS_CHUNK', 'CHUNK_OF' FROM chunk
  UNION ALL SELECT code_uuid, technique_id, 'HAS_LABEL', 'LABEL_OF' FROM chunk WHERE class = 'accepted'
) SELECT src, dst, type FROM forward UNION ALL SELECT dst, src, back FROM forward""")
def analysed_edges(t: Tables) -> DataFrame:
    return pipelines.analysis_tables(_analyses(t), 4)["edges"]


@query(f"""WITH {_ANALYSES} SELECT software AS software_name, name AS file_name, about AS chunk_number, technique_id, count(*) AS n FROM findings f JOIN file ON o_orderkey = l_orderkey
WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.l_orderkey = f.l_orderkey AND l.l_linenumber = f.about AND code <> ' ') GROUP BY ALL""")
def unmatched_findings(t: Tables) -> DataFrame:
    return pipelines.unmatched_findings(_analyses(t))


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def labelled_files(t: Tables) -> DataFrame:
    chunks = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("chunks"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "image").otherwise("code")
    return lookup.labelled_files(t.orders.join(chunks, "o_orderkey", "left").withColumn("file_type", kind)).select("o_orderkey")


@query("""WITH met AS (SELECT o_custkey, p_brand, min(l_orderkey * 100 + l_linenumber) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 5 <> 0 GROUP BY ALL)
SELECT o_custkey AS owner, row_number() OVER (PARTITION BY o_custkey ORDER BY place, p_brand NULLS FIRST)::INTEGER AS pos, p_brand AS group_name, (
  SELECT string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) FROM orders o JOIN lineitem ON l_orderkey = o_orderkey JOIN part p ON p_partkey = l_partkey
  WHERE o.o_custkey = met.o_custkey AND CASE WHEN p_partkey % 5 <> 0 THEN p.p_brand END IS NOT DISTINCT FROM met.p_brand) AS names FROM met""")
def labels_by_first_sight(t: Tables) -> DataFrame:
    """The labels of every owner's chunks by group, groups in the order in which they are met; every fifth label has none."""
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(
        F.col("o_custkey").alias("owner"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("group_name"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"), F.col("p_partkey").cast("string").alias("name"),
    )
    out = graph.groups_in_order(rows, ["owner"], "group_name", "at", "name")
    return out.select("owner", "pos", "group_name", F.array_join("items", ",").alias("names"))


# --- parsed documents ----------------------------------------------------------------------------------------------------

_PARSED = """parsed AS (SELECT 'conv-' || conv_id AS name, turn, text FROM conversations WHERE NOT (turn % 5 = 0 AND turn % 3 = 0)),
whole AS (SELECT name, string_agg(coalesce(text, ''), '' ORDER BY turn, coalesce(text, '')) AS full_text FROM parsed GROUP BY name),
parts AS (SELECT name, pos, substr(full_text, pos * 300 + 1, 300) AS part FROM (SELECT *, unnest(range(0, ceil(length(full_text) / 300.0)::BIGINT)) AS pos FROM whole) x),
passed AS (
  SELECT name, pos, 0 AS k, 'L' || ascii(part) % 9 AS label_id FROM parts WHERE length(part) % 2 = 0
  UNION ALL SELECT name, pos, 1, 'end' FROM parts WHERE length(part) < 300
)"""


def _label(part: Column) -> Column:
    relevance = F.when(F.length(part) % 2 == 0, F.lit(0.95)).otherwise(F.lit(0.5))
    first = F.struct(F.concat(F.lit("L"), F.ascii(part) % 9).alias("label_id"), relevance.alias("relevance"), F.lit("seen").alias("evidence"))
    second = F.struct(F.lit("end").alias("label_id"), F.lit(0.9).alias("relevance"), F.when(F.length(part) < 300, "end").otherwise("").alias("evidence"))
    return F.struct(F.lit("success").alias("status"), F.array(first, second).alias("labels"))


def _parsed(t: Tables) -> dict[str, DataFrame]:
    turn = F.col("turn")
    rows = t.conversations.select(
        F.concat(F.lit("conv-"), "conv_id").alias("name"), turn.alias("chunk_number"), F.col("text").alias("content"),
        F.when(turn % 5 == 0, "image").otherwise("text").alias("chunk_type"), F.when(turn % 3 == 0, 0).when(turn % 3 == 1, 1).alias("safe_sign"),
    )
    return pipelines.document_tables(rows, _label, lambda c: F.substring(c, 1, 30), 2, 300)


@query(f"""WITH {_PARSED}, ids AS (SELECT name, string_agg(label_id, ',' ORDER BY pos, k) AS label_ids FROM passed GROUP BY name)
SELECT name, full_text, 'userUpload-' || name AS source_info, coalesce(label_ids, '') AS label_ids, left(full_text, 30) AS article_summary, 2 AS insert_number FROM whole LEFT JOIN ids USING (name)""")
def ingested_documents(t: Tables) -> DataFrame:
    out = _parsed(t)["document"]
    return out.select("name", "full_text", "source_info", F.array_join("label_ids", ",").alias("label_ids"), "article_summary", "insert_number")


@query(f"""WITH {_PARSED}, forward AS (
  SELECT name AS src, {_ID.format("chunk", "name, turn::VARCHAR")} AS dst, 'HAS_CHUNK' AS type, 'CHUNK_OF' AS back FROM parsed
  UNION ALL SELECT DISTINCT name, label_id, 'HAS_LABEL', 'LABEL_OF' FROM passed
) SELECT src, dst, type FROM forward UNION ALL SELECT dst, src, back FROM forward""")
def ingested_document_edges(t: Tables) -> DataFrame:
    return _parsed(t)["edges"]


# --- back-fills ----------------------------------------------------------------------------------------------------------

_NAMED = "named AS (SELECT c_custkey AS owner_id, CASE WHEN c_custkey % 10 = 0 THEN 'shared ' || c_custkey % 70 ELSE 'c' || c_custkey END AS name FROM customer)"


def _urls(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    owners = t.customer.select(key.alias("owner_id"), F.when(key % 10 == 0, F.concat(F.lit("shared "), key % 70)).otherwise(F.concat(F.lit("c"), key)).alias("name"))
    urls = owners.where("owner_id % 3 <> 0").select("name", F.concat(F.lit("http://h/"), "owner_id", F.lit("/")).alias("url"))
    order = F.col("o_orderkey")
    files = t.orders.select(F.col("o_custkey").alias("owner_id"), F.concat(F.lit("dir/f "), order, F.lit(".py")).alias("name"), F.when(order % 4 == 0, "old").alias("repo_url"))
    own = t.orders.where(order % 2 == 0).join(owners, F.col("o_custkey") == F.col("owner_id"))
    folder = F.explode(F.when(order % 8 == 0, F.array(F.lit("src"), F.lit("a (b)"))).otherwise(F.array(F.lit("src"))))
    paths = own.select("name", order, folder.alias("d")).select("name", F.concat("d", F.lit("/f "), order, F.lit(".py")).alias("path"))
    return pipelines.backfill_urls(owners, files, urls, paths, "owner_id")


@query(f"""WITH {_NAMED}, single AS (SELECT * FROM named WHERE name IN (SELECT name FROM named GROUP BY name HAVING count(*) = 1) AND owner_id % 3 <> 0)
SELECT o_custkey AS owner_id, 'dir/f ' || o_orderkey || '.py' AS name, CASE WHEN s.owner_id IS NOT NULL AND o_orderkey % 2 = 0
  THEN 'http://h/' || s.owner_id || '/src/branch/main/' || CASE WHEN o_orderkey % 8 = 0 THEN 'a%20%28b%29' ELSE 'src' END || '/f%20' || o_orderkey || '.py'
  WHEN o_orderkey % 4 = 0 THEN 'old' END AS repo_url FROM orders LEFT JOIN single s ON s.owner_id = o_custkey""")
def urls_backfilled(t: Tables) -> DataFrame:
    return _urls(t)[0].select("owner_id", "name", "repo_url")


@query(f"""WITH {_NAMED} SELECT name, count(*) AS n FROM named WHERE name IN (SELECT name FROM named WHERE owner_id % 3 <> 0) GROUP BY name HAVING count(*) > 1""")
def urls_shared(t: Tables) -> DataFrame:
    return _urls(t)[1].select("name", "n")


@query("""WITH d AS (SELECT doc_id, 'd' || CASE WHEN doc_id % 10 = 0 THEN doc_id % 40 ELSE doc_id END AS name, text FROM documents),
ok AS (SELECT name FROM d WHERE name IN (SELECT name FROM d WHERE doc_id % 4 <> 1) GROUP BY name HAVING count(*) = 1)
SELECT doc_id || '-' || pos AS id, CASE WHEN name IN (SELECT name FROM ok) THEN 'http://h/' || doc_id WHEN pos % 2 = 1 THEN 'old' END AS url
FROM (SELECT doc_id, name, unnest(range(0, ceil(length(text) / 2000.0)::BIGINT)) AS pos FROM d) x""")
def document_urls_backfilled(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    name = F.concat(F.lit("d"), F.when(key % 10 == 0, key % 40).otherwise(key))
    docs = t.documents.select("doc_id", name.alias("name"), "text", F.lit(None).cast("string").alias("repo_url"))
    urls = docs.where("doc_id % 4 <> 1").select("name", F.concat(F.lit("http://h/"), "doc_id").alias("url"))
    parts = docs.select("doc_id", "name", "repo_url", F.posexplode(text.fixed_windows(F.col("text"), 2000)).alias("pos", "part"))
    chunks = parts.select(F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), "name", "repo_url", "pos")
    index = chunks.select(F.col("chunk_id").alias("id"), F.when(F.col("pos") % 2 == 1, "old").alias("url"))
    return projects.backfill_document_urls(docs, chunks.drop("pos"), index, urls)[2].select("id", "url")


# --- names and main files ------------------------------------------------------------------------------------------------

_NAMES = ("js", "TSX", "py", "C++", "c", "rs", "CS", "go")


@query("""WITH own AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '.pptx' WHEN 1 THEN '.DOC' WHEN 2 THEN '.docx' ELSE '.txt' END AS e, ['js', 'TSX', 'py', 'C++', 'c', 'rs', 'CS', 'go'][p_partkey % 8 + 1] AS told FROM part)
SELECT p_partkey, p_name || CASE WHEN p_partkey % 4 = 3 THEN e ELSE '.pdf' END AS pdf, ['javascript', 'typescript', 'python', 'cpp', 'cpp', 'rust', 'csharp', 'go'][p_partkey % 8 + 1] AS language,
  CASE WHEN p_partkey % 3 = 0 THEN 'C:/other/' || p_name ELSE p_brand || '/' || p_name END AS relative, 'part-' || left(sha256(p_name || chr(31) || p_partkey), 32) AS id FROM own""")
def file_names(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    end = F.when(key % 4 == 0, ".pptx").when(key % 4 == 1, ".DOC").when(key % 4 == 2, ".docx").otherwise(".txt")
    told = F.element_at(F.array(*map(F.lit, _NAMES)), (key % 8 + 1).cast("int"))
    path = F.when(key % 3 == 0, F.concat(F.lit("C:\\other\\"), "p_name")).when(key % 3 == 1, F.concat(F.lit("C:\\base\\"), "p_brand", F.lit("\\"), "p_name")).otherwise(F.concat(F.lit("C:/base/"), "p_brand", F.lit("/"), "p_name"))
    return t.part.select(
        "p_partkey", text.as_pdf_name(F.concat("p_name", end)).alias("pdf"), text.normal_language(told).alias("language"),
        text.relative_path(path, F.lit("C:\\base\\")).alias("relative"), text.stable_id("part", F.col("p_name"), key).alias("id"),
    )


class _Suggests:
    """A model that knows the last two of the files it is told, invents one, and has nothing to say of some projects."""

    def __call__(self, prompt: str) -> str:
        told = json.loads(prompt.split("\n", 1)[1])
        if told["software_name"].endswith("1"):
            return "I cannot tell."
        return "Sure: " + json.dumps({"main_files": ["invented.py", *told["files"][-2:]]})


@query("""WITH files AS (SELECT DISTINCT p_brand AS project, lower(replace(p_type, ' ', '/')) || '/' || CASE WHEN p_partkey % 6 = 0 THEN 'main_' ELSE 'x' END || p_partkey || '.py' AS path FROM part),
told AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY len(string_split(path, '/')), path) AS n FROM files QUALIFY n <= 50),
suggested AS (SELECT project, string_agg(path, ',' ORDER BY n) AS x FROM (SELECT *, max(n) OVER (PARTITION BY project) - n AS back FROM told) y WHERE back < 2 AND NOT ends_with(project, '1') GROUP BY project),
named AS (SELECT project, string_agg(name, ',' ORDER BY name) AS x FROM (
  SELECT project, name, row_number() OVER (PARTITION BY project ORDER BY name) AS n FROM (SELECT DISTINCT project, regexp_extract(path, '[^/]*$') AS name FROM files) z
  WHERE regexp_matches(name, 'main|index|app|server|client|core|init|setup|config|start|run') QUALIFY n <= 10) w GROUP BY project)
SELECT DISTINCT project, coalesce(s.x, n.x, '') AS main_files FROM files LEFT JOIN suggested s USING (project) LEFT JOIN named n USING (project)""")
def main_files_chosen(t: Tables) -> DataFrame:
    """Main files as a model suggests them, as far as they exist, and by their names where it suggests none."""
    name = F.concat(F.when(F.col("p_partkey") % 6 == 0, "main_").otherwise("x"), "p_partkey", F.lit(".py"))
    path = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))), F.lit("/"), name)
    files = t.part.select(F.col("p_brand").alias("project"), path.alias("relative_path")).distinct()
    told = projects.suggested_files(files, Providers(ask=_Suggests()), 50)
    return projects.main_files(files, told).select("project", F.array_join("main_files", ",").alias("main_files"))
