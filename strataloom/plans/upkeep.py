"""Registered queries of lookups, ingestion checks, routes and expansions, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators import graph, ingest, lookup, packing, projects, retrieval
from ..runtime import shared_folder
from .catalog import _DIGEST, _EDGES, _HITS, _ROOTS, _W, Tables, _base, _edges, _index, _questions, _roots, _source_edges, query

# --- lookups and counts --------------------------------------------------------------------------------------------


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark) AND embedding IS NOT NULL")
def rows_by_ids(t: Tables) -> DataFrame:
    return lookup.by_ids(t.embeddings, t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "embedding").select("vec_id", "label")


@query("""SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY p_partkey LIMIT 1""")
def first_with_text(t: Tables) -> DataFrame:
    wanted = t.part.agg(F.min("p_type")).first()[0]
    return lookup.first_with(t.part, "p_type", wanted, "p_partkey").select("p_partkey", "p_name")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, c_mktsegment) END AS kind
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def flattened_hits(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    hit = lambda c, when=None: F.struct((F.col(c) if when is None else F.when(when, F.col(c))).alias("kind"))
    own = rows.select(
        "o_orderkey", hit("o_orderstatus", F.col("o_orderkey") % 2 == 0).alias("entity"), hit("o_orderpriority", F.col("o_orderkey") % 3 == 0).alias("nested"), hit("c_mktsegment").alias("fields"),
    )
    return own.select("o_orderkey", lookup.flattened("kind", "entity", "nested", "fields"))


_PATHS = """files AS (SELECT p_brand AS project, '/' || replace(lower(p_type), ' ', '/') || '/' || p_name AS path, p_name AS name FROM part),
asked AS (
  SELECT p_brand AS project, p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN '/' || replace(lower(p_type), ' ', '/') || '/' || p_name
    WHEN 1 THEN '/' || p_name WHEN 2 THEN p_name ELSE 'none/' || p_name || '?' END AS item FROM part
)"""


def _paths(t: Tables) -> tuple[DataFrame, DataFrame]:
    folder = F.replace(F.lower("p_type"), F.lit(" "), F.lit("/"))
    path = F.concat(F.lit("/"), folder, F.lit("/"), "p_name")
    form = F.col("p_partkey") % 4
    item = F.when(form == 0, path).when(form == 1, F.concat(F.lit("/"), "p_name")).when(form == 2, F.col("p_name")).otherwise(F.concat(F.lit("none/"), "p_name", F.lit("?")))
    rows = t.part.select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("n"), path.alias("path"), F.col("p_name").alias("name"), item.alias("item"))
    return rows.select("project", "path", "name"), rows.select("project", "n", "item")


@query(f"""WITH {_PATHS}, tries AS (
  SELECT project, n, 0 AS root, item AS path FROM asked UNION ALL SELECT project, n, 1, '/standard/' || ltrim(item, '/') FROM asked
  UNION ALL SELECT project, n, 2, '/promo/' || ltrim(item, '/') FROM asked
), found AS (SELECT project, n, arg_min(path, root) AS path FROM tries WHERE path IN (SELECT path FROM files) GROUP BY ALL)
SELECT project, n, path FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n) AS place FROM found) x WHERE place <= 5""")
def existing_paths(t: Tables) -> DataFrame:
    files, asked = _paths(t)
    return lookup.existing_paths(asked, files, ["/standard", "/promo/"], ["project"])


@query(f"""WITH {_PATHS}, met AS (
  SELECT project, n, regexp_extract(item, '[^/]*$') AS name FROM asked a WHERE EXISTS (
    SELECT 1 FROM files f WHERE f.project = a.project AND (f.path = a.item OR f.name = regexp_extract(a.item, '[^/]*$')))
) SELECT project, n, name FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n) AS place FROM met) x WHERE place <= 10""")
def known_files(t: Tables) -> DataFrame:
    files, asked = _paths(t)
    return lookup.known_files(asked, files, ["project"])


_TREE = """rows_ AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'src/node_modules/' WHEN 1 THEN 'build/' WHEN 2 THEN 'src/' ELSE '' END
  || CASE WHEN p_partkey % 9 = 0 THEN '.gitignore' ELSE p_name || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.GO' WHEN 2 THEN '.txt' ELSE '' END END AS relative FROM part)"""


def _tree(t: Tables) -> DataFrame:
    six, four = F.col("p_partkey") % 6, F.col("p_partkey") % 4
    folder = F.when(six == 0, "src/node_modules/").when(six == 1, "build/").when(six == 2, "src/").otherwise("")
    name = F.concat("p_name", F.when(four == 0, ".py").when(four == 1, ".GO").when(four == 2, ".txt").otherwise(""))
    return t.part.select(F.concat(folder, F.when(F.col("p_partkey") % 9 == 0, ".gitignore").otherwise(name)).alias("relative"))


@query(f"""WITH {_TREE}, told AS (
  SELECT CASE WHEN starts_with(relative, 'src/node_modules/') THEN 'src/node_modules' WHEN starts_with(relative, 'build/') THEN 'build' END AS folder,
    regexp_extract(relative, '[^/]*$') = '.gitignore' AS by_name FROM rows_
) SELECT count(*) AS files, count(folder) AS in_folders, count(*) FILTER (by_name AND folder IS NULL) AS by_name, count(DISTINCT folder) AS folders FROM told""")
def ignored_counts(t: Tables) -> DataFrame:
    return lookup.ignored_counts(_tree(t))


@query(f"""WITH {_TREE}, found AS (
  SELECT DISTINCT regexp_extract(lower(regexp_extract(relative, '[^/]*$')), '(\\.tar\\.gz|\\.[^.]+)$', 1) AS extension FROM rows_
), known AS (SELECT unnest(['.py', '.go', '.rs']) AS extension)
SELECT extension, 'list' AS missing FROM found WHERE extension <> '' AND extension NOT IN (SELECT extension FROM known)
UNION ALL SELECT extension, 'files' FROM known WHERE extension NOT IN (SELECT extension FROM found)""")
def extension_gap(t: Tables) -> DataFrame:
    return lookup.extension_gap(_tree(t), (".py", ".go", ".rs"))


@query("""SELECT lang, count(*) FILTER (quality = 1) AS success, count(*) FILTER (quality IS DISTINCT FROM 1) AS failed, count(*) AS total
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def status_counts(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("status", F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failed"))
    return lookup.status_counts(rows, ["lang"])


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) t WHERE n = 1""")
def distinct_attempts(t: Tables) -> DataFrame:
    return lookup.distinct_attempts(t.events, ["user_id"], "event_id", ["event_type", "props"]).select("user_id", "event_id")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Owner' ELSE 'Base' END AS last_label, CASE c_custkey % 3 WHEN 2 THEN 'Base' ELSE 'Owner' END AS first_label,
  CASE c_custkey % 3 WHEN 1 THEN 'name' ELSE 'name,segment' END AS fields FROM customer""")
def label_views(t: Tables) -> DataFrame:
    form = F.col("c_custkey") % 3
    labels = F.when(form == 0, F.array(F.lit("Base"), F.lit("Owner"), "c_mktsegment")).when(form == 1, F.array(F.lit("Owner"), F.lit("Base"))).otherwise(F.array(F.lit("Base")))
    last, first = graph.domain_label(labels, "Base"), graph.domain_label(labels, "Base", last=False)
    shown = graph.kept_fields(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment"), last, {"Owner": ("name",)})
    return t.customer.select("c_custkey", last.alias("last_label"), first.alias("first_label"), F.array_join(F.sort_array(F.map_keys(shown)), ",").alias("fields"))


@query("""SELECT r_name, n_name, row_number() OVER (ORDER BY r_name NULLS LAST, n_name NULLS LAST) AS place FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""")
def labels_in_order(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", "n_name")
    order = W.orderBy(F.asc_nulls_last("r_name"), F.asc_nulls_last("n_name"))  # one row per label
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, upper(c_name), c_mktsegment FROM customer WHERE c_acctbal > 0""")
def copied_rows(t: Tables) -> DataFrame:
    target = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_mktsegment")
    source = t.customer.where("c_acctbal > 0").select("c_custkey", F.upper("c_name").alias("c_name"), "c_mktsegment")
    return ingest.copy_collection(source, target, "insert", ["c_custkey"], [F.col("c_name")])


# --- text ----------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') AS suffix, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
  '/base/' || CASE WHEN o_orderkey % 2 = 0 THEN 'in/' || o_orderkey ELSE o_orderkey::VARCHAR END AS folder FROM orders""")
def time_and_folder(t: Tables) -> DataFrame:
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/base/in/"), "o_orderkey")).otherwise(F.concat(F.lit("/other/"), "o_orderkey", F.lit("/")))
    return t.orders.select("o_orderkey", text.time_suffix(F.col("o_orderdate")).alias("suffix"), text.iso(F.col("o_orderdate"), "timestamp").alias("iso"), text.folder_of(path, "/base").alias("folder"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 100) || chr(10) || '...' || chr(10) || right(text, 100) ELSE text END AS middle,
  CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS head, regexp_matches(lower(left(text, 20)), 'main|index|app|server|client|core|init|setup|config|start|run') AS is_main,
  CASE WHEN strpos(text, 'the') > 0 THEN len(string_split(left(text, strpos(text, 'the') - 1), chr(10))) ELSE 1 END::INTEGER AS line FROM documents""")
def text_parts(t: Tables) -> DataFrame:
    own = F.col("text")
    return t.documents.select(
        "doc_id", text.shorten_middle(own, 200).alias("middle"), text.shorten(own, 50).alias("head"),
        F.lower(F.substring(own, 1, 20)).rlike(text.MAIN_NAMES).alias("is_main"), text.line_of(own, F.lit("the")).cast("int").alias("line"),
    )


@query("""SELECT event_id, json(props)::VARCHAR AS text, (props::JSON ->> '$.k') AS k FROM events""")
def recognised_lines(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    listed = F.to_json(F.struct(F.array(F.to_json(F.from_json("props", "k long")), F.lit("")).alias("lines")))
    return t.events.select("event_id", F.rtrim(text.lines_of(listed), F.lit("\n")).alias("text"), k.alias("k"))


@query("""WITH e AS (SELECT event_id, event_type AS k, event_id % 7 AS form FROM events)
SELECT event_id, CASE WHEN form IN (0, 3) THEN 'line ' || event_id WHEN form IN (1, 2, 4) THEN 'line ' || event_id || chr(10) || k END AS text FROM e""")
def recognised_shapes(t: Tables) -> DataFrame:
    """Replies of a reader in every shape: a string, lists of strings and of objects, objects with a text or lines, and two with nothing."""
    line, kind, form = F.concat(F.lit("line "), "event_id"), F.col("event_type"), F.col("event_id") % 7
    object_ = lambda x: F.struct(x.alias("text"))
    shapes = (
        F.concat(F.lit('"'), line, F.lit('"')), F.to_json(F.array(line, kind)), F.to_json(F.array(object_(line), object_(kind))), F.to_json(object_(line)),
        F.to_json(F.struct(F.array(line, kind).alias("lines"))), F.lit('{"other": 1}'), F.lit("[]"),
    )
    return t.events.select("event_id", text.lines_of(F.coalesce(*[F.when(form == i, x) for i, x in enumerate(shapes)])).alias("text"))


@query("""WITH parts AS (SELECT l_orderkey, string_agg('{"n":' || l_linenumber || ',"at":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') || '"}', ',' ORDER BY l_linenumber, l_shipdate) AS x FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, '{"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","status":"' || o_orderstatus || '","gone":null,"parts":'
  || coalesce('[' || x || ']', 'null') || '}' AS json FROM orders LEFT JOIN parts ON l_orderkey = o_orderkey""")
def safe_rows(t: Tables) -> DataFrame:
    part = F.struct(F.col("l_linenumber").alias("n"), F.col("l_shipdate").cast("timestamp").alias("at"))
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    row = F.struct(
        F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("status"),
        F.lit(None).cast("string").alias("gone"), "parts",
    )
    return t.orders.join(parts, "o_orderkey", "left").select("o_orderkey", text.safe_json(row).alias("json"))


@query("""SELECT conv_id, turn, CASE WHEN sum(length(text)) OVER w > 400 THEN left(text, floor(length(text) * (400.0::DOUBLE / sum(length(text)) OVER w))::INTEGER) ELSE text END AS text
  FROM conversations WINDOW w AS (PARTITION BY conv_id)""")
def fitted_parts(t: Tables) -> DataFrame:
    return packing.fitted(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], "text", 400)


@query("""WITH RECURSIVE items AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS r FROM conversations
), walk AS (
  SELECT conv_id, size, r, 0 AS batch, size AS used FROM items WHERE r = 1
  UNION ALL
  SELECT i.conv_id, i.size, i.r, CASE WHEN w.used + i.size > 900 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used + i.size > 900 THEN i.size ELSE w.used + i.size END
  FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.r = w.r + 1
) SELECT conv_id, batch, count(*) AS items, sum(size)::BIGINT AS total FROM walk GROUP BY conv_id, batch""")
def batch_sizes(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return packing.batch_sizes(packing.greedy_batches(rows, ["conv_id"], "turn", "size", 900), ["conv_id"], "size")


@query(_DIGEST.format(per=200, total=700, least=100))
def short_digests(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("name", F.concat_ws("-", "role", "turn"))
    return packing.digest(rows, ["conv_id"], "turn", "name", "text", 200, 700, 100)


@query("""WITH parts AS (SELECT doc_id, pos, substr(text, pos * 5000 + 1, 5000) AS part FROM (
  SELECT doc_id, text, unnest(range(0, ceil(length(text) / 5000.0)::BIGINT))::INTEGER AS pos FROM documents) t),
told AS (SELECT doc_id, pos, left(part, 40) AS s FROM parts WHERE regexp_matches(left(part, 40), '[^\\s]')),
whole AS (SELECT doc_id, count(*)::INTEGER AS parts, string_agg(s, chr(10) ORDER BY pos) AS x FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(parts, 0) AS parts, left(x, 40) AS summary FROM documents LEFT JOIN whole USING (doc_id)""")
def two_level_summaries(t: Tables) -> DataFrame:
    return projects.summaries(t.documents, "doc_id", "text", lambda c: F.substring(c, 1, 40), 5000)


class _ReadsSome:
    """A reader of images that fails for a third of them."""

    def __call__(self, image: str) -> str:
        if len(image) % 3 == 0:
            raise OSError("too dark")
        return "first: " + image[:10]


@query("""WITH c AS (SELECT conv_id, turn, text, turn % 3 = 0 AS image, length(text) % 2 = 0 AS good FROM conversations)
SELECT conv_id, turn, CASE WHEN image AND good THEN CASE WHEN length(text) % 3 = 0 THEN 'second: ' ELSE 'first: ' END || left(text, 10) ELSE text END AS content,
  CASE WHEN image THEN good::INTEGER WHEN turn % 2 = 0 THEN 1 END::INTEGER AS safe_sign FROM c""")
def judged_images(t: Tables) -> DataFrame:
    """Every third turn stands for an image: half of them are relevant, and the first reader fails for a third."""
    from ..functions.providers import Providers

    kind = F.when(F.col("turn") % 3 == 0, "image").otherwise("text")
    chunks = t.conversations.select("conv_id", "turn", F.col("text").alias("content"), kind.alias("chunk_type"), F.when(F.col("turn") % 2 == 0, 1).cast("int").alias("safe_sign"))
    readers = Providers(judge=lambda image: len(image) % 2 == 0, read=(_ReadsSome(), lambda image: "second: " + image[:10]))
    return projects.read_images(chunks, readers).select("conv_id", "turn", "content", "safe_sign")


# --- retrieval -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_HITS} SELECT query_id, rank, id, lang, source FROM vector_hits JOIN documents ON doc_id = id""")
def hits_with_nodes(t: Tables) -> DataFrame:
    hits = retrieval.nearest(_questions(t), _index(t), "doc_id", "embedding")
    return retrieval.nodes_of(hits, t.documents.select("doc_id", "lang", "source"), "doc_id").select("query_id", "rank", "id", "lang", "source")


@query(f"""WITH {_HITS}, ways AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'text' ELSE 'vector' END AS route FROM questions)
SELECT query_id, route, rank, id, score FROM text_hits JOIN ways USING (query_id) WHERE route = 'text'
UNION ALL SELECT query_id, route, rank, id, score FROM vector_hits JOIN ways USING (query_id) WHERE route = 'vector'""")
def routed_hits(t: Tables) -> DataFrame:
    index = _index(t)
    terms = retrieval.text_index(index, "doc_id", "text")
    ways = {"text": lambda q: retrieval.bm25(q, terms), "vector": lambda q: retrieval.nearest(q, index, "doc_id", "embedding")}
    form = F.col("query_id") % 3
    return retrieval.routed(_questions(t), F.when(form == 0, "text").when(form == 1, "nowhere"), ways, "vector")


@query(f"""WITH {_HITS}, best AS (SELECT query_id, rank - 1 AS place, id FROM vector_hits),
places AS (SELECT query_id, spot, (spot * 3 + query_id) % 12 AS place FROM (SELECT query_id, unnest(range(0, 6)) AS spot FROM questions) x)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot)::INTEGER AS rank, id FROM places JOIN best USING (query_id, place)""")
def reranked_by_position(t: Tables) -> DataFrame:
    best = retrieval.nearest(_questions(t), _index(t), "doc_id", "embedding").select("query_id", (F.col("rank") - 1).alias("place"), "id")
    places = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda at: ((at * 3 + F.col("query_id")) % 12).cast("int"))  # some of them no candidate has
    return retrieval.by_position(best, _questions(t).select("query_id", places.alias("places")))


_HOPS = """one AS (
  SELECT {by} i, row_number() OVER (PARTITION BY {by} i ORDER BY type, dst) - 1 AS j, dst, type FROM roots JOIN edges ON src = id
), firsts AS (SELECT {by} dst, min(i * 1000000000 + j) AS met FROM one GROUP BY ALL),
two AS (
  SELECT {by} i, j, row_number() OVER (PARTITION BY {by} i, j ORDER BY e.type, e.dst) - 1 AS k, e.dst, e.type FROM one JOIN edges e ON e.src = one.dst
), kept AS (
  SELECT t.*, row_number() OVER (PARTITION BY {t_by} t.dst ORDER BY i, j, k) AS n FROM two t LEFT JOIN firsts f ON {same} f.dst = t.dst
  WHERE (met IS NULL OR met > i * 1000000000 + j) AND NOT EXISTS (SELECT 1 FROM roots r WHERE {root} r.id = t.dst)
)"""
_SOURCE_EDGES = """edges AS (
  SELECT doc_id::VARCHAR AS src, 'l:' || lang AS dst, 'HAS_LANG' AS type FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT * FROM (SELECT DISTINCT 'l:' || CASE WHEN toxic = 1 THEN 'en' ELSE 'de' END, 'q:' || quality, 'HAS_GRADE' FROM labels WHERE quality IS NOT NULL) x
)"""


_EXPANDED = f"""WITH {_HITS}, {_SOURCE_EDGES}, judged AS (
  SELECT query_id, id, rank, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, w)) / len(q) ELSE 0.0 END, 6)::DOUBLE AS score
  FROM vector_hits JOIN (SELECT query_id, list_distinct({_W.format("question")}) AS q FROM questions) a USING (query_id) JOIN (SELECT doc_id AS id, {_W.format("text")} AS w FROM idx) b USING (id)
), roots AS (
  SELECT query_id, i, id::VARCHAR AS id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS i FROM judged) x WHERE i < 3
), {_HOPS.format(by="query_id,", t_by="t.query_id,", same="f.query_id = t.query_id AND", root="r.query_id = t.query_id AND")}
SELECT query_id, 1 AS level, i::INTEGER AS i, j::INTEGER AS j, 0 AS k, dst AS id, type FROM one UNION ALL SELECT query_id, 2, i::INTEGER, j::INTEGER, k::INTEGER, dst, type FROM kept WHERE n = 1"""


@query(_EXPANDED)
def expanded_hits(t: Tables) -> DataFrame:
    return retrieval.expanded(_questions(t), _index(t), _source_edges(t), "doc_id", "text", "embedding")


@query(_EXPANDED)
def base_expanded_query(t: Tables) -> DataFrame:
    return _base(t).expanded_query(_questions(t))


@query(f"""WITH {_EDGES}, {_ROOTS}, parts AS (SELECT 'o' || l_orderkey AS whole_id, l_linenumber AS ord, 'p' || l_partkey AS part_id FROM lineitem),
hop AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY type, dst) AS j, dst, type FROM roots JOIN edges ON src = id),
one AS (
  SELECT i, row_number() OVER (PARTITION BY i ORDER BY j, coalesce(ord, 0), coalesce(part_id, dst)) - 1 AS j, coalesce(part_id, dst) AS dst, type
  FROM hop LEFT JOIN parts ON whole_id = dst WHERE dst NOT LIKE 'o%' OR part_id IS NOT NULL
), firsts AS (SELECT i, dst, min(j) AS met FROM one GROUP BY i, dst),
hop2 AS (SELECT i, j, row_number() OVER (PARTITION BY i, j ORDER BY e.type, e.dst) AS k, e.dst, e.type FROM one JOIN edges e ON e.src = one.dst),
two AS (
  SELECT i, j, row_number() OVER (PARTITION BY i, j ORDER BY k, coalesce(ord, 0), coalesce(part_id, dst)) - 1 AS k, coalesce(part_id, dst) AS dst, type
  FROM hop2 LEFT JOIN parts ON whole_id = dst WHERE dst NOT LIKE 'o%' OR part_id IS NOT NULL
), kept AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.i, t.dst ORDER BY j, k) AS n FROM two t LEFT JOIN firsts f ON f.i = t.i AND f.dst = t.dst
  WHERE (met IS NULL OR met > j) AND t.dst <> 'c' || t.i
) SELECT 1 AS level, i, j::INTEGER AS j, 0 AS k, dst AS id, type FROM one UNION ALL SELECT 2, i, j::INTEGER, k::INTEGER, dst, type FROM kept WHERE n = 1""")
def expanded_parts(t: Tables) -> DataFrame:
    whole = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    parts = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("whole_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("p"), "l_partkey").alias("part_id"))
    out = retrieval.expanded_parts(_roots(t), _edges(t), whole, parts, ["root"])
    return out.select("level", F.col("root").alias("i"), "j", "k", "id", "type")


@query(f"WITH {_HITS} SELECT count(*) AS wanted, true AS enough FROM vector_hits")
def cells_recall(t: Tables) -> DataFrame:
    """Whether a stored coarse index, audited on vectors that are no questions, finds at least 0.9 of all exact hits of the
    questions."""
    index, asked = _index(t), _questions(t)
    others = index.join(asked.select(F.col("query_id").alias("doc_id")), "doc_id", "left_anti")
    kept = retrieval.CellIndex(t.spark, f"{shared_folder(t.spark)}/strataloom-kept/cells-{uuid.uuid4().hex}")
    got = kept.store(index, "doc_id", "embedding", audit=others).search(asked).select("query_id", "id", F.lit(1).alias("found"))
    exact = retrieval.nearest(asked, index, "doc_id", "embedding").select("query_id", "id")
    both = exact.join(got, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
    return both.select("wanted", (F.col("found") >= retrieval.RECALL * F.col("wanted")).alias("enough"))
