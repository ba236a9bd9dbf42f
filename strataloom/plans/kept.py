"""Registered queries over what is kept and takes changes: an index in segments, a keyed table, resumed copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sql_functions
from ..functions import calls, segmenting
from ..functions.text import words
from ..operators import ingest
from ..operators.kept_index import KeptIndex
from ..operators.keyed_table import KeyedTable, upsert_batches
from ..operators.paged import PagedTable
from ..runtime import shared_folder
from ..sources import archives, collection
from ..streaming import slow_jobs as slow
from .catalog import _W, Tables, query


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/strataloom-kept/{name}-{uuid.uuid4().hex}"


# --- an inverted index that takes changes ------------------------------------------------------------------------------

_CHANGED = f"""idx AS (
  SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN reverse(text) WHEN doc_id % 12 = 1 THEN text || ' ' || text ELSE text END AS text FROM documents
  WHERE doc_id % 10 <> 7 OR doc_id % 9 = 0
),
listed AS (SELECT doc_id AS id, {_W.format("text")} AS w FROM idx WHERE text IS NOT NULL),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM listed),
posted AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM listed) t GROUP BY ALL)"""


def _changed_index(t: Tables) -> KeptIndex:
    """Three segments; documents are replaced while others are deleted, and some of the deleted come back."""
    index, docs = KeptIndex(t.spark, _folder(t, "changed")), t.documents.select("doc_id", "text")
    index.upsert(docs.where("doc_id % 3 <> 2"), "doc_id", "text")
    index.upsert(docs.where("doc_id % 3 = 2 or doc_id % 12 = 1").withColumn("text", F.when(F.col("doc_id") % 12 == 1, F.concat_ws(" ", "text", "text")).otherwise(F.col("text"))), "doc_id", "text")
    index.delete(docs.where("doc_id % 10 = 7"), "doc_id")
    index.upsert(docs.where("doc_id % 9 = 0").withColumn("text", F.reverse("text")), "doc_id", "text")
    return index


@query(f"""WITH {_CHANGED},
asked AS (SELECT DISTINCT item_id AS query_id, unnest({_W.format("text")}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
scored AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN df USING (term) JOIN posted USING (term), corpus GROUP BY query_id, id
)
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored) t WHERE rank <= 10""")
def changed_index_top(t: Tables) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return _changed_index(t).search(asked, k=10).select("query_id", "rank", "id", "score")


@query(f"""WITH {_CHANGED} SELECT term, count(*) AS df FROM posted WHERE term IN (SELECT unnest({_W.format("text")}) FROM benchmark) GROUP BY term""")
def changed_index_frequencies(t: Tables) -> DataFrame:
    index = _changed_index(t)
    index.merge(fanout=2)
    terms = t.benchmark.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct()
    return index.frequencies(terms)


# --- a table by key ------------------------------------------------------------------------------------------------------

_BATCHED = """old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal::DOUBLE AS value FROM customer WHERE c_custkey % 3 <> 0),
sent AS (
  SELECT c_custkey AS id, upper(c_mktsegment) AS name, c_nationkey::DOUBLE AS value, c_custkey % 4 AS batch FROM customer WHERE c_custkey % 2 = 0
)"""


def _batched(t: Tables) -> tuple[KeyedTable, DataFrame]:
    """A table by key that gets four batches: some rows have no name, all of batch 2 can't be cast, batch 0 comes twice."""
    table = KeyedTable.create(t.spark, _folder(t, "customers"), "id long, name string, value double", ["id"], buckets=8)
    table.insert(t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("value")), [F.col("name")])
    sent = t.customer.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.upper("c_mktsegment")).alias("name"),
        F.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("x"), "c_nationkey")).otherwise(F.col("c_nationkey").cast("string")).alias("value"),
    )
    fault = F.when(F.col("name").isNull(), "no name")
    batches = [(f"b{n}", sent.where(F.col("id") % 4 == n)) for n in (0, 2)] + [("b0", sent.where("id % 4 = 0"))]
    results = upsert_batches(table, batches, [F.col("value")], fault, lambda rows: rows.withColumn("value", F.col("value").cast("double")))
    table.update(t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("name")).where("id % 7 = 0"), "name")
    table.delete(t.customer.where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("id")))
    return table, results


@query(f"""WITH {_BATCHED},
taken AS (SELECT id, name, value FROM sent WHERE batch = 0 AND id % 5 <> 0),
both_ AS (SELECT * FROM taken UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM taken)),
later AS (SELECT o_custkey AS id, max(o_orderpriority) AS name FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1)
SELECT b.id, coalesce(l.name, b.name) AS name, b.value FROM both_ b LEFT JOIN later l ON l.id = b.id WHERE b.id % 11 <> 0""")
def keyed_rows(t: Tables) -> DataFrame:
    return _batched(t)[0].read()


@query(f"""WITH {_BATCHED} SELECT * FROM (
  SELECT 'b0' AS batch, 'taken' AS status, count(*) FILTER (id % 5 <> 0) AS taken, count(*) FILTER (id % 5 = 0) AS refused, NULL::VARCHAR AS error FROM sent WHERE batch = 0
  UNION ALL SELECT 'b2', 'failed', 0, 0, 'CAST_INVALID_INPUT' UNION ALL SELECT 'b0', 'repeated', 0, 0, NULL) x""")
def keyed_batch_results(t: Tables) -> DataFrame:
    return _batched(t)[1]


# --- copies of a collection ----------------------------------------------------------------------------------------------


@query("SELECT vec_id::VARCHAR AS vec_id, coalesce(label::VARCHAR, '') AS text, len(embedding) AS dim FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def collection_copied(t: Tables) -> DataFrame:
    """In steps of a third of the rows, by two copiers of which the second goes on where the first has stopped."""
    path, target = f"{t.sf_dir}/embeddings.parquet", _folder(t, "copy")
    clean = lambda df: ingest.clean_for_copy(df.select("vec_id", F.col("label").cast("string").alias("text"), "embedding"), "vec_id", "text", "embedding")
    first = collection.Copy(t.spark, path, target)
    rows = first.plan()[1] // 3 + 1
    first.step(rows, clean)
    out = collection.Copy(t.spark, path, target).run(rows, clean)
    return out.select("vec_id", "text", F.size("embedding").cast("long").alias("dim"))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3) AND vec_id >= 100")
def collection_filtered(t: Tables) -> DataFrame:
    """Both conditions are met inside the source."""
    return collection.pages(t.spark, f"{t.sf_dir}/embeddings.parquet").where("label in (1, 3) and vec_id >= 100").select("vec_id", "label")


# --- words of unspaced text ----------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE said AS (SELECT item_id, {_W.format("text")} AS w FROM benchmark),
counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM said) t GROUP BY word),
total AS (SELECT sum(n) AS total FROM counts),
known AS (
  SELECT map_from_entries(list((word, round(-1000 * ln(n / total))::BIGINT))) AS m, max(length(word)) AS longest, max(round(-1000 * ln(0.1 / total)))::BIGINT AS other
  FROM counts, total WHERE length(word) <= 24
),
dp AS (
  SELECT item_id, array_to_string(w, '') AS s, 0 AS i, [struct_pack(c := 0::BIGINT, n := 0::BIGINT, l := 0::BIGINT)] AS best FROM said
  UNION ALL
  SELECT item_id, s, i + 1, list_append(best, list_min(list_filter(list_transform(range(1, least(i + 1, longest) + 1), lambda k: struct_pack(
    c := best[i + 2 - k].c + coalesce(m[substr(s, i + 2 - k, k)], CASE WHEN k = 1 THEN other END), n := best[i + 2 - k].n + 1, l := -k)), lambda x: x.c IS NOT NULL)))
  FROM dp, known WHERE i < length(s)
),
back AS (
  SELECT item_id, s, best, length(s)::BIGINT AS place, ''::VARCHAR AS cut FROM dp WHERE i = length(s)
  UNION ALL SELECT item_id, s, best, place + best[place + 1].l, substr(s, place + best[place + 1].l + 1, -best[place + 1].l) || ' ' || cut FROM back WHERE place > 0
)
SELECT item_id, rtrim(cut) AS cut FROM back WHERE place = 0""")
def items_recut(t: Tables) -> DataFrame:
    """Every item without its blanks, cut again along the cheapest path."""
    cut = segmenting.cutter(t.spark, segmenting.learned(t.benchmark, "text"))
    return t.benchmark.select("item_id", F.array_join(cut(F.array_join(words(F.col("text")), "")), " ").alias("cut"))


@query()
def documents_recut(t: Tables) -> DataFrame:
    """How well words are found again in whole documents without blanks: precision, recall and F1 of their ends by language.
    Costs are learned from three quarters of the documents; `learned` tells those from the rest."""
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0
    costs = segmenting.learned(t.documents.where(learns), "text")
    told = t.documents.where("text is not null").select("lang", learns.alias("learned"), words(F.col("text")).alias("told"))
    rows = segmenting.recut(told, F.col("told"), costs)
    sums = rows.groupBy("lang", "learned").agg(F.sum("hits").alias("hits"), F.sum("ends").alias("ends"), F.sum("found_ends").alias("found_ends"))
    p, r = F.col("hits") / F.col("found_ends"), F.col("hits") / F.col("ends")
    return sums.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(2 * p * r / (p + r), 4)})


# --- jobs that take time -------------------------------------------------------------------------------------------------


@query("""WITH m AS (
  SELECT user_id || '/' || (ts::DATE)::VARCHAR AS job, date_trunc('milliseconds', ts) AS ts,
    CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS kind FROM events
),
sent AS (SELECT job, min(ts) AS submitted FROM m WHERE kind = 'submitted' GROUP BY job HAVING min(ts) + INTERVAL '6 hours' <= (SELECT max(ts) FROM m) - INTERVAL '1 day'),
own AS (SELECT m.*, submitted FROM m JOIN sent USING (job) WHERE kind <> 'submitted' AND ts BETWEEN submitted AND submitted + INTERVAL '6 hours'),
ends AS (SELECT job, min(ts) AS ended, arg_min(kind, (ts, kind)) AS status FROM own WHERE kind IN ('done', 'failed') GROUP BY job),
told AS (
  SELECT job, min(ts) FILTER (kind = 'running') AS started, count(*) AS n FROM own LEFT JOIN ends USING (job)
  WHERE ended IS NULL OR ts < ended OR (ts = ended AND kind <= status) GROUP BY job
)
SELECT job, submitted, started, ended, coalesce(status, 'timed out') AS status, (coalesce(n, 0) + 1)::INTEGER AS messages
FROM sent LEFT JOIN ends USING (job) LEFT JOIN told USING (job)""")
def slow_jobs(t: Tables) -> DataFrame:
    """A user's day is a job: sign-ups submit it, purchases end it well and errors badly; six hours are the limit."""
    kind = F.when(F.col("event_type") == "signup", "submitted").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]")
    messages = stream.select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("job"), F.date_trunc("millisecond", "ts").alias("ts"), kind.alias("kind"))
    at = _folder(t, "jobs")
    slow.follow(messages, 6 * 3600, "1 day", f"{at}/sink", f"{at}/checkpoint").awaitTermination()
    return slow.judged(t.spark, f"{at}/sink").select("job", "submitted", "started", "ended", "status", "messages")


# --- calls in flight -----------------------------------------------------------------------------------------------------


class Moody:
    """A provider that fails as often as a request's length tells, then answers."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, request: str) -> str:
        self.seen[request] = self.seen.get(request, 0) + 1
        if self.seen[request] <= len(request) % 5:
            raise OSError("busy")
        return request[:12]


@query("""WITH asked AS (SELECT conv_id, turn, conv_id || '/' || turn || ' ' || text AS request FROM conversations)
SELECT conv_id, turn, CASE WHEN length(request) % 5 < 3 THEN left(request, 12) ELSE 'later' END AS reply,
  CASE WHEN request IS NOT NULL THEN CASE WHEN length(request) % 5 < 3 THEN 'ok' ELSE 'fallback' END END AS status, least(length(request) % 5 + 1, 3)::INTEGER AS tries FROM asked""")
def called_requests(t: Tables) -> DataFrame:
    """Eight calls at once per task, three tries each, then a fallback."""
    asked = t.conversations.select("conv_id", "turn", F.concat(F.concat_ws("/", "conv_id", "turn"), F.lit(" "), "text").alias("request"))
    got = calls.called(asked, "request", Moody(), lambda request: "later", calls.Limits(in_flight=8, tries=3, wait=0.001))
    return got.select("conv_id", "turn", "reply", "status", "tries")


# --- pages by rank -------------------------------------------------------------------------------------------------------


@query("""WITH ranked AS (
  SELECT row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) - 1 AS rank, l_orderkey, l_linenumber FROM lineitem
), n AS (SELECT count(*) AS total, (count(*) + 49) // 50 AS pages FROM lineitem)
SELECT rank // 50 + 1 AS page, rank, l_orderkey, l_linenumber, rank // 50 + 1 < pages AS has_next FROM ranked, n WHERE rank // 50 + 1 IN (1, pages // 2, pages)""")
def pages_by_rank(t: Tables) -> DataFrame:
    """The first page, a middle one and the last of all lines, each from the range that holds it."""
    table = PagedTable(t.spark, _folder(t, "pages"))
    table.store(t.lineitem, ["desc l_shipdate", "l_orderkey", "l_linenumber"], range_rows=5000)
    last, out = table.page(1).pages, None
    for n in (1, last // 2, last):
        page = table.page(n)
        own = page.rows.select(F.lit(n).cast("long").alias("page"), "rank", "l_orderkey", "l_linenumber", F.lit(page.has_next).alias("has_next"))
        out = own if out is None else out.unionByName(own)
    return out


# --- the library in SQL text ---------------------------------------------------------------------------------------------


def _in_sql(t: Tables, sql: str) -> DataFrame:
    sql_functions.register(t.spark)
    t.documents.createOrReplaceTempView("sl_documents")
    t.embeddings.createOrReplaceTempView("sl_embeddings")
    return t.spark.sql(sql)


@query("""SELECT doc_id, pos, substr(text, pos * 500 + 1, 500) AS part, len(w) AS n FROM (
  SELECT doc_id, text, unnest(range(0, ceil(length(text) / 500.0)::BIGINT))::INTEGER AS pos, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents) t""")
def windows_in_sql(t: Tables) -> DataFrame:
    return _in_sql(t, "SELECT doc_id, w.pos, w.part, cast(size(sl_words(text)) AS bigint) AS n FROM sl_documents, LATERAL sl_windows(text, 500) w")


@query("""SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b
  ON b.vec_id = a.vec_id + 1 WHERE a.embedding IS NOT NULL""")
def cosine_in_sql(t: Tables) -> DataFrame:
    return _in_sql(t, "SELECT a.vec_id, b.vec_id AS other, round(sl_cosine(a.embedding, b.embedding), 6) AS cosine FROM sl_embeddings a JOIN sl_embeddings b ON b.vec_id = a.vec_id + 1")


@query()
def text_chunks_in_sql(t: Tables) -> DataFrame:
    """The rows of text_chunks, asked in SQL text: a test holds the two against each other."""
    return _in_sql(t, "SELECT * FROM sl_text_chunks(TABLE(SELECT doc_id, text FROM sl_documents), 'doc_id', 'text', 2048, 512)")


# --- archives ------------------------------------------------------------------------------------------------------------


@query("""SELECT lang || '-' || source || '.zip' AS archive, 'd' || doc_id % 10 || '/' || doc_id || '.txt' AS member, lang || '-' || source AS folder, 'ok' AS status, text
  FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL""")
def archived_documents(t: Tables) -> DataFrame:
    """Documents packed to a zip file for each language and source, and read back by index and range reads."""
    docs = t.documents.where("lang is not null and source is not null and text is not null")
    member = F.concat(F.lit("d"), F.col("doc_id") % 10, F.lit("/"), "doc_id", F.lit(".txt"))
    rows = docs.select(F.concat("lang", F.lit("-"), "source", F.lit(".zip")).alias("archive"), member.alias("member"), F.encode("text", "utf-8").alias("content"))
    got = archives.members(archives.index(archives.write_zips(rows, _folder(t, "zips").removeprefix("file:"))), task_bytes=1 << 20)
    return got.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "member", "folder", "status", F.decode("content", "utf-8").alias("text"))
