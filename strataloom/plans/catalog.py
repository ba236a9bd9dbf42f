"""Registered queries: each applies an operator to whole test tables and has its SQL beside it.

The test tables stand for the engine's own: customer, orders, lineitem and part for owners, files, chunks and labels of
the graph; documents with embeddings for the chunk index; benchmark items for questions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..api import KnowledgeBase
from ..functions import chunking, parsing, text
from ..functions.providers import Providers
from ..operators import graph, ingest, matching, packing, pipelines, retrieval
from ..operators.kept_index import KeptIndex
from ..operators.versions import Conflict
from ..runtime import shared_folder, ship
from ..streaming import jobs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def files(self, name: str) -> list:
        """The file statuses of a table: one file, or a folder of them."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        return list(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["retrieve_reranked"](spark, sf_dir)


MONEY = "decimal(18,2)"

# --- scans, filters, projections -----------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05""")
def filtered_projection(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber", "l_partkey")


_GATE = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN 'none'
  WHEN l_returnflag = 'R' AND CASE WHEN l_partkey % 7 <> 0 THEN l_discount END >= 0.09 THEN 'accepted' ELSE 'low' END AS class FROM lineitem"""


@query(_GATE)
def relevance_gate(t: Tables) -> DataFrame:
    label = F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey"))  # some rows without a label, some without a relevance
    relevance = F.when(F.col("l_partkey") % 7 != 0, F.col("l_discount"))
    gate = ingest.gate_class(label, F.col("l_returnflag") == "R", relevance, 0.09)
    return t.lineitem.select("l_orderkey", "l_linenumber", gate.alias("class"))


@query(f"SELECT class, count(*) AS n FROM ({_GATE}) t GROUP BY class")
def gate_counts(t: Tables) -> DataFrame:
    return relevance_gate(t).groupBy("class").agg(F.count("*").alias("n"))


@query("""SELECT doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality >= 1 AND toxic = 0""")
def article_gate(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality >= 1 and toxic = 0"), "doc_id").select("doc_id")


@query("""SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' OR d.doc_id % 11 = 0 THEN 'no text' WHEN embedding IS NULL THEN 'no vector'
  WHEN d.doc_id % 5 = 0 THEN 'wrong dimension' END AS fault FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def vector_faults(t: Tables) -> DataFrame:
    rows = t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    rows = rows.withColumn("text", F.when(F.col("doc_id") % 11 != 0, F.col("text")))
    rows = rows.withColumn("embedding", F.when(F.col("doc_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return rows.select("doc_id", ingest.vector_fault(F.col("doc_id"), F.col("text"), F.col("embedding"), 64).alias("fault"))


@query("SELECT min(len(embedding))::INTEGER AS least, max(len(embedding))::INTEGER AS most FROM embeddings")
def vector_dimension(t: Tables) -> DataFrame:
    return ingest.dimension(t.embeddings, "embedding")


@query("""SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN '无描述' WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END
  AS preview FROM documents""")
def previews(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.preview(F.col("text"), 100).alias("preview"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\\s]')""")
def non_blank(t: Tables) -> DataFrame:
    return t.documents.where(text.has_text(F.col("text"))).select("doc_id")


@query("""SELECT c_custkey, c_name, count(*) OVER () AS total, 50 < count(*) OVER () AS has_next, false AS has_prev FROM customer
  ORDER BY c_name NULLS LAST, c_custkey LIMIT 50""")
def first_page(t: Tables) -> DataFrame:
    return graph.page(t.customer.select("c_custkey", "c_name"), [F.asc_nulls_last("c_name"), F.asc("c_custkey")], 1, 50)


@query("""SELECT pos, id, coalesce(c_name, 'unknown') AS c_name, c_custkey IS NOT NULL AS found
  FROM (VALUES (0, 7), (1, 999999999), (2, 3), (3, 7)) r(pos, id) LEFT JOIN customer ON c_custkey = id""")
def details_by_request(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([(0, 7), (1, 999999999), (2, 3), (3, 7)], "pos int, id int")
    nodes = t.customer.select(F.col("c_custkey").alias("id"), "c_name")
    return graph.requested(ids, nodes, {"c_name": F.lit("unknown")}).select("pos", "id", "c_name", "found")


# --- graph ---------------------------------------------------------------------------------------------------------


def _edges(t: Tables) -> DataFrame:
    files = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("HAS_FILE").alias("type"))
    labels = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("HAS_LABEL").alias("type"))
    return graph.mirrored(files.unionByName(labels.distinct()), {"HAS_FILE": "FILE_OF", "HAS_LABEL": "LABEL_OF"})


_EDGES = """forward AS (
  SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'HAS_FILE' AS type FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'HAS_LABEL' FROM lineitem
), edges AS (
  SELECT * FROM forward UNION ALL SELECT dst, src, CASE type WHEN 'HAS_FILE' THEN 'FILE_OF' ELSE 'LABEL_OF' END FROM forward
)"""
_ROOTS = "roots AS (SELECT c_custkey AS i, 'c' || c_custkey AS id FROM customer)"


def _roots(t: Tables) -> DataFrame:
    """Every owner as a root of its own set."""
    return t.customer.select(F.col("c_custkey").alias("root"), F.lit(0).alias("i"), F.concat(F.lit("c"), "c_custkey").alias("id"))


@query(f"WITH {_EDGES} SELECT * FROM edges")
def mirrored_edges(t: Tables) -> DataFrame:
    return _edges(t)


@query(f"""WITH {_EDGES} SELECT DISTINCT src, dst, type FROM edges e WHERE NOT (type = 'HAS_FILE' AND EXISTS (
  SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND 'c' || o_custkey = src AND 'o' || o_orderkey = dst))""")
def absent_edges(t: Tables) -> DataFrame:
    there = t.orders.where("o_orderstatus = 'F'")
    there = there.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("HAS_FILE").alias("type"))
    return ingest.absent_edges(_edges(t), there)


@query(f"""WITH {_EDGES}, {_ROOTS} SELECT i, id, row_number() OVER (PARTITION BY i ORDER BY type, dst) - 1 AS j, dst, type
  FROM roots JOIN edges ON src = id""")
def one_hop(t: Tables) -> DataFrame:
    return graph.neighbours(_roots(t), _edges(t), ["root"]).select(F.col("root").alias("i"), "id", F.col("j").cast("long").alias("j"), "dst", "type")


@query(f"""WITH {_EDGES}, {_ROOTS}, hop AS (
  SELECT i, id, row_number() OVER (PARTITION BY i ORDER BY type, dst) - 1 AS j, dst, type FROM roots JOIN edges ON src = id
), parts AS (SELECT 'o' || l_orderkey AS whole_id, l_linenumber AS ord, 'l' || l_orderkey || '.' || l_linenumber AS part_id FROM lineitem)
SELECT i, j, coalesce(ord, 0) AS sub, coalesce(part_id, dst) AS dst FROM hop LEFT JOIN parts ON whole_id = dst
WHERE dst NOT LIKE 'o%' OR part_id IS NOT NULL""")
def files_opened(t: Tables) -> DataFrame:
    whole = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    parts = t.lineitem.select(
        F.concat(F.lit("o"), "l_orderkey").alias("whole_id"), F.col("l_linenumber").alias("ord"),
        F.concat(F.lit("l"), "l_orderkey", F.lit("."), "l_linenumber").alias("part_id"),
    )
    out = graph.with_parts(graph.neighbours(_roots(t), _edges(t), ["root"]), whole, parts, ["root"])
    return out.select(F.col("root").alias("i"), F.col("j").cast("long").alias("j"), "sub", "dst")


@query(f"""WITH {_EDGES}, {_ROOTS}, one AS (
  SELECT i, row_number() OVER (PARTITION BY i ORDER BY type, dst) - 1 AS j, dst, type FROM roots JOIN edges ON src = id
), firsts AS (SELECT i, dst, min(j) AS met FROM one GROUP BY i, dst),
two AS (
  SELECT i, j, row_number() OVER (PARTITION BY i, j ORDER BY e.type, e.dst) - 1 AS k, e.dst, e.type FROM one JOIN edges e ON e.src = one.dst
), kept AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.i, t.dst ORDER BY j, k) AS n FROM two t LEFT JOIN firsts f ON f.i = t.i AND f.dst = t.dst
  WHERE (met IS NULL OR met > j) AND t.dst <> 'c' || t.i
)
SELECT 1 AS level, i, j, 0::BIGINT AS k, dst AS id, type FROM one UNION ALL SELECT 2, i, j, k, dst, type FROM kept WHERE n = 1""")
def two_hop_expansion(t: Tables) -> DataFrame:
    out = graph.two_hops(_roots(t), _edges(t), ["root"])
    return out.select("level", F.col("root").alias("i"), F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"), "id", "type")


@query(f"""WITH {_EDGES}, starts AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders),
ends AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 'c' || c_custkey FROM customer),
loops AS (SELECT id AS src, id AS dst, 'SAME' AS type FROM ends WHERE id LIKE 'c%'), every AS (SELECT * FROM edges UNION ALL SELECT * FROM loops),
one AS (SELECT id AS start, src, dst, type FROM starts JOIN every ON src = id),
two AS (SELECT start, e.dst AS "end" FROM one JOIN every e ON e.src = one.dst WHERE (e.src, e.dst, e.type) <> (one.src, one.dst, one.type))
SELECT DISTINCT start, "end" FROM (SELECT start, dst AS "end" FROM one UNION ALL SELECT start, "end" FROM two) x WHERE "end" IN (SELECT id FROM ends)""")
def trails_to_labels(t: Tables) -> DataFrame:
    # a node is a number, three times its key and its kind, which travels in fewer bytes than its name
    number = lambda kind, key: (F.col(key).cast("long") * 3 + "cop".index(kind)).alias("id")
    kind = lambda id: F.pmod(id, F.lit(3)).cast("int")
    name = lambda id: F.concat(F.substring(F.lit("cop"), kind(id) + 1, F.lit(1)), F.call_function("div", id - kind(id), F.lit(3)))
    owners, files, labels = t.customer.select(number("c", "c_custkey")), t.orders.select(number("o", "o_orderkey")), t.part.select(number("p", "p_partkey"))
    edge = lambda d, src, dst, type: d.select(src.alias("src"), dst.alias("dst"), F.lit(type).alias("type"))
    own = edge(t.orders, number("c", "o_custkey"), number("o", "o_orderkey"), "HAS_FILE")
    # a label that a file has twice is one edge, which the trails tell themselves
    told = edge(t.lineitem, number("o", "l_orderkey"), number("p", "l_partkey"), "HAS_LABEL")
    loops = edge(owners, F.col("id"), F.col("id"), "SAME")  # an edge that a trail may use once only
    edges = graph.mirrored(own.unionByName(told), {"HAS_FILE": "FILE_OF", "HAS_LABEL": "LABEL_OF"}).unionByName(loops)
    found = graph.trails(owners.unionByName(files), edges, labels.unionByName(owners))
    return found.select(name(F.col("start")).alias("start"), name(F.col("end")).alias("end"))


@query("""SELECT p_partkey, o_orderkey, l_linenumber FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
  WHERE p_brand = 'Brand#11'""")
def label_to_files(t: Tables) -> DataFrame:
    own = t.part.where("p_brand = 'Brand#11'").select("p_partkey")
    rows = t.lineitem.join(own, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("p_partkey", "o_orderkey", "l_linenumber")


@query("""SELECT DISTINCT c_custkey, c_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey WHERE p_size = 10""")
def label_to_owners(t: Tables) -> DataFrame:
    files = t.lineitem.join(t.part.where("p_size = 10"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    owners = t.orders.join(files, "o_orderkey").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(owners, "c_custkey", "left_semi").select("c_custkey", "c_name").dropDuplicates(["c_custkey"])


@query("""SELECT o_custkey, o_orderkey, string_agg(coalesce(p_name, ''), chr(10) || chr(10) ORDER BY l_linenumber, coalesce(p_name, '')) AS text
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_custkey, o_orderkey""")
def owner_detail_texts(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left")
    return graph.ordered_text(rows, ["o_custkey", "o_orderkey"], "l_linenumber", "p_name", "\n\n")


@query("""SELECT c_custkey, o_orderkey, l_linenumber FROM customer LEFT JOIN orders ON o_custkey = c_custkey
  LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def owner_file_chunk_outer(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("c_custkey", "o_orderkey", "l_linenumber")


@query("""SELECT s_suppkey, n_name, r_name FROM (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier) s
  LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def label_hierarchy(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_nationkey").distinct().join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def labels_by_group(t: Tables) -> DataFrame:
    rows = t.nation.dropDuplicates(["n_nationkey"]).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.count("*").alias("n"))


# --- aggregation ---------------------------------------------------------------------------------------------------


@query("SELECT 'document' AS label, count(*) AS n FROM documents UNION ALL SELECT 'owner', count(*) FROM customer")
def label_counts(t: Tables) -> DataFrame:
    parts = [d.agg(F.lit(x).alias("label"), F.count("*").alias("n")) for d, x in ((t.documents, "document"), (t.customer, "owner"))]
    return parts[0].unionByName(parts[1])


@query("SELECT count(*) AS n, count(*) > 0 AS any_double FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) t")
def duplicate_names(t: Tables) -> DataFrame:
    doubles = t.part.groupBy("p_name").agg(F.count("*").alias("c")).where("c > 1")
    return doubles.agg(F.count("*").alias("n"), (F.count("*") > 0).alias("any_double"))


@query("""SELECT kind, n, round(100.0 * n / sum(n) OVER (), 1)::DOUBLE AS share FROM (
  SELECT regexp_extract(lower(regexp_extract(url, '^[^?#]*')), '(\\.[a-z0-9]+)$', 1) AS kind, count(*) AS n FROM pages GROUP BY 1) t""")
def extension_histogram(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    kinds = t.pages.groupBy(F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1).alias("kind")).agg(F.count("*").alias("n"))
    share = F.round(F.lit(100) * F.col("n").cast("decimal(20,1)") / F.sum("n").over(W.partitionBy()), 1).cast("double")
    return kinds.withColumn("share", share)


@query("""SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id""")
def conversation_texts(t: Tables) -> DataFrame:
    return graph.ordered_text(t.conversations, ["conv_id"], "turn", "text", "")


@query("""SELECT conv_id, bool_or(role = 'assistant') AS result, len(flatten(list(CASE WHEN role = 'assistant'
  THEN regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') ELSE [] END)))::INTEGER AS n FROM conversations GROUP BY conv_id""")
def merged_batches(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", (F.col("role") == "assistant").alias("ok"), text.words(F.col("text")).alias("items"))
    return ingest.merged_results(rows, ["conv_id"], "turn", "ok", "items").select("conv_id", "result", F.size("items").alias("n"))


@query("""WITH RECURSIVE items AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS r FROM conversations
), walk AS (
  SELECT conv_id, turn, size, r, 0 AS batch, size AS used FROM items WHERE r = 1
  UNION ALL
  SELECT i.conv_id, i.turn, i.size, i.r, CASE WHEN w.used + i.size > 1500 THEN w.batch + 1 ELSE w.batch END,
    CASE WHEN w.used + i.size > 1500 THEN i.size ELSE w.used + i.size END
  FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.r = w.r + 1
) SELECT conv_id, turn, size, batch FROM walk""")
def greedy_batches(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return packing.greedy_batches(rows, ["conv_id"], "turn", "size", 1500)


_DIGEST = """WITH RECURSIVE items AS (
  SELECT conv_id, chr(10) || '=== ' || role || '-' || turn || ' ===' || chr(10) AS head, CASE WHEN length(text) > {per} THEN left(text, {per}) || chr(10) || '...' ELSE text END AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role || '-' || turn, left(text, {per} + 1)) AS r FROM conversations WHERE length(text) > 0
), walk AS (
  SELECT conv_id, r, CASE WHEN length(head || body) + 1 <= {total} THEN head || body || chr(10) WHEN {total} - length(head) > {least} THEN head || left(body, {total} - length(head)) || '...' || chr(10) ELSE '' END AS x,
    length(head || body) + 1 > {total} AS done FROM items WHERE r = 1
  UNION ALL
  SELECT i.conv_id, i.r, CASE WHEN w.done THEN w.x WHEN length(w.x) + length(head || body) + 1 <= {total} THEN w.x || head || body || chr(10)
    WHEN {total} - length(w.x) - length(head) > {least} THEN w.x || head || left(body, {total} - length(w.x) - length(head)) || '...' || chr(10) ELSE w.x END,
    w.done OR length(w.x) + length(head || body) + 1 > {total}
  FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.r = w.r + 1
) SELECT conv_id, arg_max(x, r) AS digest FROM walk GROUP BY conv_id"""


@query(_DIGEST.format(per=20_000, total=80_000, least=500))
def file_digests(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("name", F.concat_ws("-", "role", "turn"))
    return packing.digest(rows, ["conv_id"], "turn", "name", "text", 20_000, 80_000)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    money = lambda c: F.sum(F.col(c).cast(MONEY)).cast("double")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("qty"), money("l_extendedprice").alias("price"))


@query("""SELECT n_regionkey, c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS total FROM customer
  JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)""")
def segment_rollup(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.rollup("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast(MONEY)).cast("double").alias("total"))


@query("""SELECT event_type, lang, count(*) AS n FROM events CROSS JOIN (SELECT 1) x JOIN documents ON doc_id = user_id GROUP BY CUBE (event_type, lang)""")
def event_cube(t: Tables) -> DataFrame:
    return t.events.join(t.documents, F.col("doc_id") == F.col("user_id")).cube("event_type", "lang").agg(F.count("*").alias("n"))


# --- ordinals, sets, text ------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, (floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) + 1)::BIGINT AS batch FROM orders""")
def batch_numbers(t: Tables) -> DataFrame:
    return matching.batch_numbers(t.orders.select("o_orderkey"), "o_orderkey", 1000)


@query("""SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) t WHERE n = 1""")
def last_of_each(t: Tables) -> DataFrame:
    return ingest.keep_last(t.conversations, ["conv_id", "role"], [F.col("turn")]).select("conv_id", "role", "turn")


@query("""SELECT conv_id, turn, CASE WHEN before IS NULL THEN text ELSE right(before, 300) || chr(10) || text END AS text FROM (
  SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) t""")
def overlapping_chunks(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", matching.overlap_before(F.col("text"), ["conv_id"], "turn", 300).alias("text"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def still_to_do(t: Tables) -> DataFrame:
    return ingest.todo(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings) a
  UNION ALL SELECT 'first', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings) b
  UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings) c""")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id"))
    out = None
    for name, rows in (("both", a.intersect(b)), ("first", a.exceptAll(b).distinct()), ("any", a.union(b).distinct())):
        own = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT doc_id, pos, substr(text, pos * 25000 + 1, 25000) AS part FROM (
  SELECT doc_id, text, unnest(range(0, ceil(length(text) / 25000.0)::BIGINT))::INTEGER AS pos FROM documents) t""")
def fixed_windows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(text.fixed_windows(F.col("text"), 25_000)).alias("pos", "part"))


@query("""SELECT p_partkey, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '\\.[^.]+$', ''),
  '[^a-z0-9_-]', '_', 'g'), '[_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100), ''), 'file') AS slug FROM part""")
def name_slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("""SELECT p_partkey, 'https://host/repo/src/branch/main/' || replace(replace(replace(replace(url_encode(p_type || '/' || p_name), '+', '%20'), '%2F', '/'), '*', '%2A'), '%7E', '~') AS url FROM part""")
def source_urls(t: Tables) -> DataFrame:
    path = F.concat_ws("/", "p_type", "p_name")
    return t.part.select("p_partkey", text.source_url(F.lit("https://host/repo/"), F.lit("main"), path).alias("url"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, json_exists(props::JSON, '$.k') AS valid FROM events""")
def parsed_properties(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), F.coalesce(F.array_contains(F.json_object_keys("props"), "k"), F.lit(False)).alias("valid"))


@query("""SELECT event_id, json(props)::VARCHAR AS found, (props::JSON ->> '$.k')::BIGINT AS k FROM events""")
def extracted_replies(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```\nThat is all."))
    found = parsing.extract_json(reply, "k")
    return t.events.select("event_id", found.alias("found")).withColumn("k", F.get_json_object("found", "$.k").cast("long"))


@query()
def text_chunks(t: Tables) -> DataFrame:
    return chunking.chunk_texts(t.documents, "doc_id", "text")


@query()
def code_chunks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.lit("text").alias("language"))
    return chunking.chunk_files(rows, "doc_id", "text", "language")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g')[:2000], '([.!?])\s+', '\1' || chr(1), 'g') AS x FROM documents),
s AS (SELECT doc_id, unnest(string_split(x, chr(1))) AS s, unnest(range(1, len(string_split(x, chr(1))) + 1)) AS i FROM t),
fits AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS upto FROM s),
told AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i)[:100] AS description FROM fits WHERE i = 1 OR upto <= 100 GROUP BY doc_id)
SELECT doc_id, description FROM documents LEFT JOIN told USING (doc_id)""")
def described_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", Providers().description(F.col("text")).alias("description"))


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM w) x),
hashed AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
  list_reduce(list_prepend(xor(c, x), range(0, 8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))) AS h FROM bytes),
v AS (SELECT item_id, h % 64 AS d, sum(CASE WHEN h & 65536 <> 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM w JOIN hashed USING (w) GROUP BY ALL),
norm AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY item_id HAVING sum(v * v) > 0),
told AS (SELECT item_id, list(coalesce(v, 0.0::DOUBLE) / n ORDER BY d) AS embedding FROM (SELECT *, unnest(range(0, 64)) AS d FROM norm) x LEFT JOIN v USING (item_id, d) GROUP BY item_id)
SELECT item_id, embedding FROM benchmark LEFT JOIN told USING (item_id)""")
def embedded_questions(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", Providers().embedding(F.col("text")).alias("embedding"))


@query("""WITH files AS (SELECT p_partkey, replace(lower(p_type), ' ', '/') || '/' || replace(p_name, ' ', '_') || '.py' AS path FROM part),
wanted AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN path WHEN p_partkey % 3 = 1 THEN regexp_extract(path, '[^/]*/[^/]*$') ELSE regexp_extract(path, '[^/]*$') END AS item FROM files),
hits AS (
  SELECT item, path, CASE WHEN path = item THEN 0 WHEN ends_with(path, '/' || item) THEN 1 ELSE 2 END AS rule
  FROM wanted JOIN files ON regexp_extract(path, '[^/]*$') = regexp_extract(item, '[^/]*$')
) SELECT item, path, rule FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY rule, path) AS n FROM hits) t WHERE n = 1""")
def resolved_paths(t: Tables) -> DataFrame:
    path = F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".py"))
    files = t.part.select("p_partkey", path.alias("path"))
    form = F.col("p_partkey") % 3
    item = F.when(form == 0, F.col("path")).when(form == 1, F.substring_index("path", "/", -2)).otherwise(F.substring_index("path", "/", -1))
    return matching.resolve_paths(files.select(item.alias("item")).distinct(), files)


@query("""WITH parts AS (SELECT DISTINCT string_split(replace(p_type, ' ', '/') || '/' || p_name, '/') AS p FROM part),
rows_ AS (
  SELECT DISTINCT array_to_string(p[1:level - 1], '/') AS parent, p[level] AS name, len(p) = level AS is_file, level::INTEGER AS level
  FROM (SELECT p, unnest(range(1, least(len(p), 3) + 1)) AS level FROM parts) t
)
SELECT parent, name, is_file, level, repeat('│   ', level - 1) || CASE WHEN lead(name) OVER (PARTITION BY parent ORDER BY is_file, lower(name), name) IS NULL
  THEN '└── ' ELSE '├── ' END || name AS line FROM rows_""")
def file_tree(t: Tables) -> DataFrame:
    paths = t.part.select(F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit("/")), F.lit("/"), "p_name").alias("path")).distinct()
    return matching.tree_lines(paths)


# --- ingestion -----------------------------------------------------------------------------------------------------

_OLD = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"
_NEW = "SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment FROM customer WHERE c_acctbal > 0"


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_mktsegment")
    return old, t.customer.where("c_acctbal > 0").select("c_custkey", F.upper("c_name").alias("c_name"), "c_mktsegment")


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def insert_if_absent(t: Tables) -> DataFrame:
    return ingest.insert_if_absent(*_old_new(t), ["c_custkey"], [F.col("c_name")])


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)")
def upsert_rows(t: Tables) -> DataFrame:
    return ingest.upsert(*_old_new(t), ["c_custkey"], [F.col("c_name")])


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT o.c_custkey, coalesce(n.c_name, o.c_name) AS c_name, o.c_mktsegment FROM old o LEFT JOIN new n USING (c_custkey)")
def updated_property(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    return ingest.update(old, new, ["c_custkey"], "c_name")


@query(f"""WITH old AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, c_mktsegment FROM ({_OLD}) o), new AS ({_NEW})
  SELECT o.c_custkey, coalesce(o.c_name, n.c_name) AS c_name, o.c_mktsegment FROM old o LEFT JOIN new n USING (c_custkey)""")
def filled_if_null(t: Tables) -> DataFrame:
    old, new = _old_new(t)
    old = old.withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    return ingest.update(old, new, ["c_custkey"], "c_name", only_null=True)


@query("""SELECT vec_id::VARCHAR AS vec_id, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE embedding IS NOT NULL""")
def cleaned_for_copy(t: Tables) -> DataFrame:
    rows = t.embeddings.join(t.documents, F.col("doc_id") == F.col("vec_id"), "left").select("vec_id", "text", "embedding")
    return ingest.clean_for_copy(rows, "vec_id", "text", "embedding").select("vec_id", "text")


# --- retrieval -----------------------------------------------------------------------------------------------------


def _questions(t: Tables) -> DataFrame:
    rows = t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id"))
    return rows.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("embedding").alias("vector"))


def _index(t: Tables) -> DataFrame:
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "embedding")


#: Keys that are sent to all texts at most, instead of dealing both by key.
SENT_KEYS = 1_000_000


def _index_texts(t: Tables) -> DataFrame:
    """The index's texts, of which only those with a vector travel: these often lie together in a few files, and then one task
    would cut them all."""
    keys = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    keys = F.broadcast(keys) if keys.limit(SENT_KEYS + 1).count() <= SENT_KEYS else keys.hint("shuffle_hash")
    return t.documents.select("doc_id", "text").join(keys, "doc_id").repartition("doc_id")


_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_DOT = "list_reduce(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE), lambda x, y: x + y)"
_NORMAL = "CASE WHEN max(score) OVER (PARTITION BY query_id) <> 0 THEN round(score / max(score) OVER (PARTITION BY query_id), 6) ELSE 0.0 END AS normalised"
_HITS = f"""questions AS (SELECT item_id AS query_id, text AS question, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id),
idx AS (SELECT doc_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
listed AS (SELECT doc_id AS id, {_W.format("text")} AS w FROM idx),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM listed WHERE w IS NOT NULL),
posted AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM listed) t GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, unnest({_W.format("question")}) AS term FROM questions),
df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
scored AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN df USING (term) JOIN posted USING (term), corpus GROUP BY query_id, id
),
text_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored) t WHERE rank <= 50),
text_hits AS (SELECT *, {_NORMAL} FROM text_top),
near AS (
  SELECT query_id, doc_id AS id, round({_DOT.format("vector", "embedding")} / (sqrt({_DOT.format("vector", "vector")}) * sqrt({_DOT.format("embedding", "embedding")})), 6) AS score
  FROM questions, idx
),
vector_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM near) t WHERE rank <= 10),
vector_hits AS (SELECT *, {_NORMAL} FROM vector_top),
both_ AS (
  SELECT query_id, id, coalesce(t.normalised, 0) AS text_score, coalesce(v.normalised, 0) AS vector_score, t.rank AS t, v.rank AS v,
    round((1 - 0.6) * coalesce(t.normalised, 0) + 0.6 * coalesce(v.normalised, 0), 6) AS score
  FROM text_hits t FULL JOIN vector_hits v USING (query_id, id)
),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t NULLS LAST, v NULLS LAST)::INTEGER AS rank FROM both_) x WHERE rank <= 10)"""


def _kept_index(t: Tables) -> KeptIndex:
    """The stored index of the chunk texts: made once for each state of the tables, loaded after that."""
    state = "|".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for n in ("documents", "embeddings") for f in t.files(n)))
    index = KeptIndex(t.spark, f"{shared_folder(t.spark)}/strataloom-kept/lists-{hashlib.sha256(state.encode()).hexdigest()[:24]}")
    if not index.snapshot().segments:
        try:
            index.upsert(_index_texts(t), "doc_id", "text")
        except Conflict:
            pass  # another session has stored the same
    return index


@query(f"WITH {_HITS} SELECT query_id, rank, id, score, normalised FROM text_hits")
def bm25_top(t: Tables) -> DataFrame:
    return _kept_index(t).search(_questions(t)).select("query_id", "rank", "id", "score", "normalised")


@query(f"WITH {_HITS} SELECT query_id, rank, id, score, normalised FROM vector_hits")
def vector_top(t: Tables) -> DataFrame:
    return retrieval.nearest(_questions(t), _index(t), "doc_id", "embedding").select("query_id", "rank", "id", "score", "normalised")


@query(f"WITH {_HITS} SELECT query_id, rank, id, text_score, vector_score, score FROM fused")
def hybrid_top(t: Tables) -> DataFrame:
    q, index = _questions(t), _index(t)
    out = retrieval.fused(_kept_index(t).search(q), retrieval.nearest(q, index, "doc_id", "embedding"))
    return out.select("query_id", "rank", "id", "text_score", "vector_score", "score")


@query(f"""WITH {_HITS}, listed_hits AS (
  SELECT query_id, id, min(source * 1000 + rank) AS place FROM (
    SELECT query_id, id, 0 AS source, rank FROM vector_hits UNION ALL SELECT query_id, id, 1, rank FROM fused) t GROUP BY ALL
), judged AS (
  SELECT query_id, id, place, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, w)) / len(q) ELSE 0.0 END, 6)::DOUBLE AS score
  FROM listed_hits JOIN (SELECT query_id, list_distinct({_W.format("question")}) AS q FROM questions) a USING (query_id)
  JOIN (SELECT doc_id AS id, {_W.format("text")} AS w FROM idx) b USING (id)
) SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place)::INTEGER AS rank FROM judged) t WHERE rank <= 5""")
def retrieve_reranked(t: Tables) -> DataFrame:
    return retrieval.retrieve(_questions(t), _index(t), "doc_id", "text", "embedding", terms=_kept_index(t))


@query(f"""WITH posted AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_W.format("text")}) AS term FROM documents) t GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posted GROUP BY term""")
def term_statistics(t: Tables) -> DataFrame:
    return retrieval.term_statistics(retrieval.postings(t.documents, "doc_id", "text"))


# --- time ----------------------------------------------------------------------------------------------------------


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2""")
def hourly_events(t: Tables) -> DataFrame:
    return jobs.windowed(t.events, "1 hour").withColumn("total", F.col("total").cast("double"))


@query("""SELECT start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM (
  SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * unnest(range(0, 4))::INTEGER) AS start, event_type, value FROM events) t GROUP BY 1, 2""")
def sliding_events(t: Tables) -> DataFrame:
    return jobs.windowed(t.events, "1 hour", "15 minutes").withColumn("total", F.col("total").cast("double"))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS fresh FROM events) a
  ) b GROUP BY user_id, s""")
def user_sessions(t: Tables) -> DataFrame:
    return jobs.sessions(t.events, "30 minutes")


@query("""SELECT o_orderkey, event_id AS as_of FROM (
  SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) e
  ON e.user_id = o.o_custkey AND e.ts <= o.o_orderdate""")
def order_as_of_event(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    right = t.events.groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return matching.as_of(left, right, ["user_id"], "ts", "event_id").select("o_orderkey", "as_of")


@query("""SELECT e.event_id, s.event_id AS span_id FROM events e JOIN events s ON s.event_type = 'signup' AND e.event_type = 'purchase'
  AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL '10 minutes'""")
def events_in_spans(t: Tables) -> DataFrame:
    spans = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 10 minutes")).alias("end"))
    points = t.events.where("event_type = 'purchase'").select("event_id", "ts")
    return matching.range_join(points, spans, "ts", "start", "end", 600).select("event_id", "span_id")


# --- the base as a whole -------------------------------------------------------------------------------------------


def _base(t: Tables) -> KnowledgeBase:
    return KnowledgeBase(
        owners=t.customer.select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description")),
        files=t.orders.select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("name")),
        chunks=t.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("start_line"),
            F.col("l_linestatus").alias("text"), F.col("l_partkey").alias("label_id"),
        ),
        articles=t.documents.select(
            F.col("doc_id").alias("article_id"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.col("text").alias("summary"), F.col("text").alias("full_text"),
            F.array(F.col("doc_id") % 7, F.col("doc_id") % 11).alias("label_ids"),
        ),
        labels=t.part.select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("group_name")),
        index=_index(t).withColumnRenamed("doc_id", "chunk_id"),
        edges=_source_edges(t),
    )


def _source_edges(t: Tables) -> DataFrame:
    own = t.documents.where("lang is not null").select(F.col("doc_id").cast("string").alias("src"), F.concat(F.lit("l:"), "lang").alias("dst"), F.lit("HAS_LANG").alias("type"))
    near = t.labels.select(F.concat(F.lit("l:"), F.when(F.col("toxic") == 1, "en").otherwise("de")).alias("src"), F.concat(F.lit("q:"), "quality").alias("dst"), F.lit("HAS_GRADE").alias("type"))
    return own.unionByName(near.where("dst is not null").distinct())


_BASE = """articles AS (SELECT doc_id AS article_id, 'doc ' || doc_id AS title, text AS summary, [doc_id % 7, doc_id % 11] AS label_ids FROM documents)"""
_CUT = "CASE WHEN coalesce(length({0}), 0) = 0 THEN '无描述' WHEN length({0}) > {1} THEN substr({0}, 1, {1}) || '...' ELSE {0} END"


@query("SELECT 'document' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'software', count(*) FROM customer")
def base_counts(t: Tables) -> DataFrame:
    return _base(t).counts()


@query("SELECT p_partkey AS label_id, p_name AS name, p_type AS description FROM part WHERE p_partkey = 5")
def base_label_description(t: Tables) -> DataFrame:
    return _base(t).label_description(5)


@query(f"""WITH {_BASE} SELECT 'document' AS kind, article_id::VARCHAR AS id, title AS name FROM articles WHERE list_contains(label_ids, 5)
  UNION ALL SELECT DISTINCT 'software', c_custkey::VARCHAR, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_partkey = 5""")
def base_by_label(t: Tables) -> DataFrame:
    return _base(t).by_label(5)


@query(f"WITH {_BASE} SELECT article_id, title, {_CUT.format('summary', 100)} AS preview FROM articles WHERE list_contains(label_ids, 5)")
def base_articles_by_label(t: Tables) -> DataFrame:
    return _base(t).articles_by_label(5)


@query(f"""WITH {_BASE} SELECT article_id, title, {_CUT.format('summary', 200)} AS preview, (SELECT count(*) FROM articles) AS total,
  (SELECT count(*) FROM articles) > 100 AS has_next, true AS has_prev FROM articles ORDER BY title NULLS LAST, article_id LIMIT 50 OFFSET 50""")
def base_all_articles(t: Tables) -> DataFrame:
    return _base(t).all_articles(2)


@query(f"""SELECT c_custkey AS owner_id, c_name AS name, {_CUT.format('c_mktsegment', 200)} AS preview, (SELECT count(*) FROM customer) AS total,
  (SELECT count(*) FROM customer) > 50 AS has_next, false AS has_prev FROM customer ORDER BY c_name NULLS LAST, c_custkey LIMIT 50""")
def base_all_owners(t: Tables) -> DataFrame:
    return _base(t).all_owners()


@query("""WITH r(pos, id, kind) AS (VALUES (0, '7', 'software'), (1, '3', 'document'), (2, '1', 'other'), (3, '999999999', 'software'), (4, '4', 'software')),
per AS (SELECT o_custkey, o_orderkey, string_agg(coalesce(l_linestatus, ''), chr(10) || chr(10) ORDER BY l_linenumber, coalesce(l_linestatus, '')) AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
whole AS (SELECT o_custkey, string_agg(x, chr(10) || chr(10) ORDER BY o_orderkey) AS x FROM per GROUP BY o_custkey)
SELECT pos, id, kind, doc_id IS NOT NULL AS found, 'doc ' || doc_id AS name, text FROM r LEFT JOIN documents ON doc_id::VARCHAR = id WHERE kind = 'document'
UNION ALL SELECT pos, id, kind, c_custkey IS NOT NULL, c_name, x FROM r LEFT JOIN customer ON c_custkey::VARCHAR = id LEFT JOIN whole ON o_custkey = c_custkey WHERE kind = 'software'""")
def base_details(t: Tables) -> DataFrame:
    asked = [(0, "7", "software"), (1, "3", "document"), (2, "1", "other"), (3, "999999999", "software"), (4, "4", "software")]
    return _base(t).details(t.spark.createDataFrame(asked, "pos int, id string, kind string"))


@query("""SELECT p_brand AS group_name, string_agg(p_name, ',' ORDER BY p_name, p_partkey) AS names, count(*) AS n FROM part WHERE p_partkey IN (
  SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7) GROUP BY p_brand""")
def base_labels_of_owner(t: Tables) -> DataFrame:
    return _base(t).labels_of_owner(7)


@query()
def cells_top(t: Tables) -> DataFrame:
    """From a coarse index that is stored once for each state of the vectors."""
    state = "|".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for n in ("documents", "embeddings") for f in t.files(n)))
    kept = retrieval.CellIndex(t.spark, f"{shared_folder(t.spark)}/strataloom-kept/cells-{hashlib.sha256(state.encode()).hexdigest()[:24]}")
    if kept.versions.last()[1] is None:
        kept.store(_index(t), "doc_id", "embedding")
    return kept.search(_questions(t))


@query("""WITH kinds AS (
  SELECT regexp_extract(lower(regexp_extract(p_name || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.GO' ELSE '' END, '[^/]*$')), '(\\.tar\\.gz|\\.[^.]+)$', 1) AS extension, p_partkey % 5 = 0 AS ignored FROM part
), counts AS (SELECT extension, extension IN ('.py', '.go') AND NOT ignored AS kept, count(*) AS n FROM kinds GROUP BY ALL)
SELECT extension, kept, n, round(100.0 * n / sum(n) OVER (PARTITION BY kept), 1)::DOUBLE AS share FROM counts""")
def project_statistics(t: Tables) -> DataFrame:
    form = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(form == 0, ".py").when(form == 1, ".GO").otherwise(""))
    folder = F.when(F.col("p_partkey") % 5 == 0, "node_modules/").otherwise("src/")
    return pipelines.file_statistics(t.part.select(F.concat(folder, name).alias("relative")))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_mktsegment WHEN c_name IS NOT NULL THEN lower(c_name) END AS vector FROM customer""")
def vectors_backfilled(t: Tables) -> DataFrame:
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("vector"))
    return pipelines.backfill_vectors(nodes, "text", "vector", F.lower).select("id", "vector")


from . import ingestion, kept, upkeep  # noqa: E402, F401  register their queries here
