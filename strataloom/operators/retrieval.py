"""Retrieval over a chunk index: BM25, exact cosine, linear fusion, reranking. Queries come in batches.

Postings carry only the terms that are asked for into the join; each ranking keeps k rows a query, which Spark limits per
partition before its shuffle. Vectors meet the queries in hash-dealt blocks, which hand on k rows a query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import cosine, words
from ..runtime import shared_folder, ship
from .graph import neighbours, second_hop, two_hops, with_parts
from .versions import Versions

K1, B = 1.2, 0.75
TEXT_K, VECTOR_K, FUSED_K, VECTOR_WEIGHT = 50, 10, 10, 0.6
RERANKED = 5
#: Scores are rounded, so that the order of summation decides no rank.
DIGITS = 6
#: Queries that a block compares at a time.
QUERY_PART = 256
#: Recall that a search in cells has to reach, what its audit asks for so that other questions reach it too, and the queries
#: that the audit asks at most.
RECALL, AUDIT_RECALL, AUDITED = 0.9, 0.95, 400
#: Vectors of a cell that one task takes, about.
CELL_ROWS = 16_384
#: Bytes of vectors (eight a component) that one task takes of the index, and of the questions, about.
BLOCK_BYTES, ASKED_BYTES = 16 << 20, 8 << 20
#: Places of a first level whose second one is sorted in one task, about.
PLACES = 3000
#: Ids of hits that are sent to all texts at most, instead of dealing both by id.
SENT_HITS = 200_000


@dataclass(frozen=True)
class TextIndex:
    """postings (id, term, dl, tf) and size, one row (n, avgdl): all that BM25 needs of a corpus."""

    postings: DataFrame
    size: DataFrame

    def store(self, folder: str) -> TextIndex:
        """Written once, by term, so that readers skip the parts without theirs, and read back; what is there is replaced."""
        self.postings.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        self.size.write.mode("overwrite").parquet(f"{folder}/size")
        return TextIndex.load(self.postings.sparkSession, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> TextIndex:
        return TextIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/size"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term, dl, tf): counted words and the document's length."""
    listed = docs.select(F.col(key).alias("id"), words(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    # from a plain explode the optimizer infers filters on the words and cuts every text up to three times
    each = listed.select("id", "dl", F.explode_outer("w").alias("term")).where("term is not null")
    return each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def text_index(docs: DataFrame, key: str, text: str) -> TextIndex:
    """The index of docs, whose texts are cut once: all words are those of the postings. Null texts count for nothing."""
    posted = postings(docs, key, text)
    n = docs.agg(F.count(text).alias("n"))
    # one row each
    size = posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).join(F.broadcast(n))
    return TextIndex(posted, size.select("n", F.when(F.col("n") > 0, F.col("words") / F.col("n")).alias("avgdl")))


def term_statistics(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    n = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", n).where(F.col("rank") <= k)


def normalised(hits: DataFrame) -> DataFrame:
    """Scores divided by the best of their query; 0 where that is 0."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return hits.withColumn("normalised", F.when(best != 0, F.round(F.col("score") / best, DIGITS)).otherwise(0.0))


def bm25(queries: DataFrame, index: TextIndex, k: int = TEXT_K, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, id, score, normalised) for queries (query_id, question); blank queries get nothing."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("question")))).alias("term"))
    wanted = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # a posting is weighed once, whoever asks for it; the corpus' figures are one row
    weighed = wanted.join(df, "term").join(F.broadcast(index.size)).select("term", "id", part.alias("part"))
    hits = asked.join(weighed, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return normalised(top(hits, k, F.desc("score"), F.asc("id")))


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    return F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _directions(column: pd.Series) -> np.ndarray:
    """Rows of length one; a power of two brings each near one first, so that no square overflows or vanishes."""
    x = np.array(column.to_list(), np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _block_hits(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.sort_values("id", kind="stable")
    ids, x, q_ids, q = rows["id"].array, _directions(rows["v"]), asked["query_id"].array, _directions(asked["q"])
    out = []
    for at in range(0, len(q), QUERY_PART):
        score = np.round(q[at : at + QUERY_PART] @ x.T, DIGITS)
        few = min(k, len(ids))
        least = -np.partition(-score, few - 1, axis=1)[:, few - 1 : few]
        r, c = np.nonzero(score >= least)  # ties too, of which those with the smallest ids stay
        order = np.lexsort((c, -score[r, c], r))
        r, c = r[order], c[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < few
        r, c = r[best], c[best]
        out.append(pd.DataFrame({"query_id": q_ids.take(at + r), "id": ids.take(c), "score": score[r, c]}))
    return pd.concat(out)


def _parts_of(vectors: DataFrame, size: str, most: int) -> int:
    """Into how many parts of about `most` bytes vectors go."""
    return max(1, -(-int(vectors.agg(F.coalesce(F.sum(8 * F.col(size).cast("long")), F.lit(0))).first()[0]) // most))


def nearest(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int = VECTOR_K, blocks: int | None = None, parts: int | None = None) -> DataFrame:
    """(query_id, rank, id, score, normalised) by exact cosine for queries (query_id, vector). Rows are dealt to blocks by
    their id and questions to parts, as many as their bytes ask for, so that a task holds one of either, whatever their
    number; every block gives k rows for each question. Rows and questions travel once for each part and block of the other
    side. Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another dimension."""
    spark = queries.sparkSession
    ship(spark)
    rows = index.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(_usable(F.col("v"))).withColumn("dim", F.size("v"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).where(_usable(F.col("q"))).withColumn("dim", F.size("q"))
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), _parts_of(rows, "dim", BLOCK_BYTES))
    parts = parts or _parts_of(asked, "dim", ASKED_BYTES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts) if parts > 1 else F.lit(0))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    kinds = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            return _block_hits(a, b, k)
        return pd.DataFrame({"query_id": b["query_id"][:0], "id": a["id"][:0], "score": np.zeros(0)})

    by = ("block", "part", "dim")
    hits = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(meet, kinds)
    return normalised(top(hits, k, F.desc("score"), F.asc("id")))


def fused(text_hits: DataFrame, vector_hits: DataFrame, k: int = FUSED_K, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Hits of both kinds by id, a missing score 0, ranked by the weighted sum; ties keep the order of the text hits and
    after them that of the others."""
    t = text_hits.select("query_id", "id", F.col("normalised").alias("text_score"), F.col("rank").alias("t"))
    v = vector_hits.select("query_id", "id", F.col("normalised").alias("vector_score"), F.col("rank").alias("v"))
    both = t.join(v, ["query_id", "id"], "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("text_score", "vector_score")})
    score = F.round((1 - weight) * F.col("text_score") + weight * F.col("vector_score"), DIGITS)
    return top(both.withColumn("score", score), k, F.desc("score"), F.asc_nulls_last("t"), F.asc_nulls_last("v")).drop("t", "v")


def first_of(*lists: DataFrame) -> DataFrame:
    """(query_id, id, source, place): union of hit lists, each id where it comes first."""
    every = None
    for n, hits in enumerate(lists):
        own = hits.select("query_id", "id", F.lit(n).alias("source"), F.col("rank").alias("place"))
        every = own if every is None else every.unionByName(own)
    n = F.row_number().over(W.partitionBy("query_id", "id").orderBy("source", "place"))
    return every.withColumn("n", n).where("n = 1").drop("n")


def reranked(hits: DataFrame, score: Column, k: int = RERANKED, drop_single: bool = False) -> DataFrame:
    """The k best of each query by another score, ties in their order; drop_single gives nothing for one hit alone."""
    scored = hits.withColumn("score", F.round(score, DIGITS))
    if drop_single:
        scored = scored.withColumn("c", F.count("*").over(W.partitionBy("query_id"))).where("c > 1").drop("c")
    return top(scored, k, F.desc("score"), F.asc("source"), F.asc("place"))


def word_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that a text holds: the offline reranker, without Python."""
    q = F.array_distinct(words(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(0.0)


def stored(hits: DataFrame) -> DataFrame:
    """Hits, a few rows a query that are read more than once, written to the shared folder and read back."""
    at = f"{shared_folder(hits.sparkSession)}/strataloom-kept/hits-{uuid.uuid4().hex}"
    hits.write.parquet(at)
    return hits.sparkSession.read.schema(hits.schema).parquet(at)


def texts_of(hits: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of what was hit: ids of the hits go to the texts if they are few, so that no other text travels."""
    ids = hits.select(F.col("id").alias(key)).distinct()
    ids = F.broadcast(ids) if ids.limit(SENT_HITS + 1).count() <= SENT_HITS else ids.hint("shuffle_hash")
    return index.select(key, text).join(ids, key, "left_semi").select(F.col(key).alias("id"), F.col(text).alias("text"))


def with_question(queries: DataFrame, hits: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    return hits.join(queries.select("query_id", "question"), "query_id").join(texts_of(hits, index, key, text), "id")


def scored(queries: DataFrame, hits: DataFrame, index: DataFrame, key: str, text: str, score: Column | None) -> DataFrame:
    """hits with `judged`: the given expression over question and text, or word_overlap() of the two, for which a question is
    cut once for all its hits. Hits are found once, before their texts are read."""
    hits = stored(hits)
    if score is not None:
        return with_question(queries, hits, index, key, text).withColumn("judged", score)
    asked = queries.select("query_id", F.array_distinct(words(F.col("question"))).alias("q"))
    found = hits.join(asked, "query_id").join(texts_of(hits, index, key, text), "id")
    share = F.when(F.size("q") > 0, F.size(F.array_intersect("q", words(F.col("text")))) / F.size("q")).otherwise(0.0)
    return found.withColumn("judged", share).drop("q", "text")


def retrieve(
    queries: DataFrame, index: DataFrame, key: str, text: str, vector: str, score: Column | None = None, drop_single: bool = False, terms=None
) -> DataFrame:
    """Vector hits, then fused hits, each id once, reranked: (query_id, rank, id, score) for queries (query_id, question,
    vector). `terms` is a stored index of the same texts, if there is one: a TextIndex or a KeptIndex."""
    near = nearest(queries, index, key, vector)
    by_text = bm25(queries, terms or text_index(index, key, text)) if terms is None or isinstance(terms, TextIndex) else terms.search(queries)
    both = fused(by_text, near)
    hits = scored(queries, first_of(near, both), index, key, text, score)
    return reranked(hits, F.col("judged"), drop_single=drop_single).select("query_id", "rank", "id", "score")


def nodes_of(hits: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Hits (query_id, rank, id, ...) with the columns of the nodes they stand for; hits without a node go."""
    return hits.join(nodes.withColumnRenamed(key, "id"), "id")


def by_position(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, rank, id): candidates (query_id, place, id) in the order of a reranker's `places` (query_id, places), which
    count from 0. Places that no candidate has are passed over."""
    asked = places.select("query_id", F.posexplode("places").alias("at", "place"))
    found = asked.join(candidates.select("query_id", "place", "id"), ["query_id", "place"])
    return found.select("query_id", F.row_number().over(W.partitionBy("query_id").orderBy("at")).alias("rank"), "id")


def expanded_questions(queries: DataFrame, expand: Callable[[Column], Column], embed: Callable[[Column], Column]) -> DataFrame:
    """queries with the question as a model restates it, and that one's vector; where it gives nothing both stay."""
    told = queries.withColumn("__q", expand(F.col("question")))
    told = told.withColumn("__q", F.when(F.coalesce(F.trim("__q"), F.lit("")) != "", F.col("__q")))
    changed = ~F.col("__q").eqNullSafe(F.col("question")) & F.col("__q").isNotNull()
    told = told.withColumn("vector", F.coalesce(embed(F.when(changed, F.col("__q"))), "vector"))
    return told.withColumn("question", F.coalesce("__q", "question")).drop("__q")


def expanded(
    queries: DataFrame,
    index: DataFrame,
    edges: DataFrame,
    key: str,
    text: str,
    vector: str,
    k: int = 3,
    score: Column | None = None,
    parts: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(query_id, level, i, j, k, id, type): the neighbours over two edges of each query's k best vector hits after reranking;
    i is a hit's place. A node counts as met within its own query only; edges run between ids of the index as text. With
    `parts` (wholes, parts), nodes that are wholes stand for their parts on both levels, as in expanded_parts()."""
    near = first_of(nearest(queries, index, key, vector))
    best = reranked(scored(queries, near, index, key, text, score), F.col("judged"), k)
    best = best.select("query_id", (F.col("rank") - 1).alias("i"), F.col("id").cast("string").alias("id"))
    return two_hops(best, edges, ["query_id"]) if parts is None else expanded_parts(best, edges, *parts, ["query_id"])


def expanded_parts(roots: DataFrame, edges: DataFrame, whole: DataFrame, parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """two_hops() with nodes of `whole` (id) replaced by their parts (whole_id, ord, part_id) in both rounds: the second
    starts from the parts of what the first has met. (by, level, i, j, k, id, type); numbers count after the replacement."""
    by = by or []
    one = stored(_opened(neighbours(roots, edges, by), whole, parts, by, ["i"], "j").select(*by, "i", "j", "dst", "type"))
    # what a node leads to is the same wherever it is met, so it is opened and numbered once for each node, and listed there
    met = one.where("dst is not null").select(F.col("dst").alias("i"), F.col("dst").alias("id")).distinct()
    ahead = _opened(neighbours(met, edges), whole, parts, [], ["i"], "k").select(F.col("i").alias("id"), "k", "dst", "type")
    tasks = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-one.count() // PLACES))
    return second_hop(roots, one, ahead, by, tasks)


def _opened(found: DataFrame, whole: DataFrame, parts: DataFrame, by: list[str], root: list[str], place: str) -> DataFrame:
    out = with_parts(found.withColumnRenamed(place, "j"), whole, parts, by)
    again = F.row_number().over(W.partitionBy(*by, *root).orderBy("j", "sub", "dst")) - 1
    return out.withColumn(place, again)


def routed(queries: DataFrame, route: Column, ways: dict[str, Callable[[DataFrame], DataFrame]], default: str) -> DataFrame:
    """(query_id, route, rank, id, score): each query answered by the way that `route` names, unknown names and null by the
    default. Every way sees its own queries only."""
    told = F.when(route.isin(*ways), route).otherwise(F.lit(default))
    marked = queries.withColumn("__route", told)
    out = None
    for name, way in sorted(ways.items()):
        got = way(marked.where(F.col("__route") == name).drop("__route")).select("query_id", F.lit(name).alias("route"), "rank", "id", "score")
        out = got if out is None else out.unionByName(got)
    return out


def cells(index: DataFrame, vector: str, k: int, sample_rows: int = 100_000, seed: int = 7):
    """Centres of a coarse quantizer, as a fitted k-means over unit vectors. It is fitted on about sample_rows vectors, a
    documented bound; every vector is assigned."""
    from pyspark.ml.clustering import KMeans

    good = _unit(index, vector)
    n = good.count()
    part = good.sample(min(1.0, sample_rows / max(n, 1)), seed)
    return KMeans(k=k, featuresCol="__unit", predictionCol="cell", seed=seed, maxIter=10).fit(part)


def _unit(rows: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))
    good = rows.withColumn("__norm", norm).where("__norm > 0 and __norm < double('infinity')")
    return good.withColumn("__unit", array_to_vector(F.transform(vector, lambda x: x / F.col("__norm")))).drop("__norm")


def assigned(model, index: DataFrame, vector: str) -> DataFrame:
    """index with the `cell` of each vector, to be stored partitioned by it; vectors without a direction are left out."""
    return model.transform(_unit(index, vector)).drop("__unit")


def _centres(model) -> list:
    """Of a fitted model, or of a list of them as it is stored."""
    return model if isinstance(model, list) else model.clusterCenters()


def _hits_in_cells(model, in_cells: DataFrame, queries: DataFrame, key: str, vector: str, probes: int, k: int) -> DataFrame:
    """The k best hits over the `probes` cells closest to a query; `n` is the place of a hit's cell among them."""
    spark = queries.sparkSession
    ship(spark)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(_centres(model))], "cell int, __c array<double>")
    # one row per cell
    far = queries.join(F.broadcast(centres), F.size("vector") == F.size("__c")).withColumn("d", cosine(F.col("vector"), F.col("__c")))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("d"), "cell"))
    asked = far.withColumn("n", n).where(F.col("n") <= probes).select("query_id", "cell", "n", F.col("vector").cast("array<double>").alias("q"))
    # a cell that holds many of the vectors is dealt to several tasks; one row per cell is broadcast
    parts = F.broadcast(in_cells.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")))
    asked = asked.where(_usable(F.col("q"))).join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = in_cells.select("cell", F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    rows = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    kinds = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, n int, score double"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            return _block_hits(a, b, k).merge(b[["query_id", "n"]], on="query_id")[["query_id", "id", "n", "score"]]
        return pd.DataFrame({"query_id": b["query_id"][:0], "id": a["id"][:0], "n": np.zeros(0, np.int32), "score": np.zeros(0)})

    hits = rows.drop("parts").groupBy("cell", "part").cogroup(asked.drop("parts").groupBy("cell", "part")).applyInPandas(meet, kinds)
    return top(hits, k, F.desc("score"), F.asc("id"))


def nearest_in_cells(model, in_cells: DataFrame, queries: DataFrame, key: str, vector: str, probes: int, k: int = VECTOR_K) -> DataFrame:
    """Like nearest(), over the `probes` cells whose centres are closest to a query. Only those are read from an index that
    is stored by cell."""
    return normalised(_hits_in_cells(model, in_cells, queries, key, vector, probes, k).drop("n"))


def audited_probes(
    model, in_cells: DataFrame, queries: DataFrame, key: str, vector: str, least: float = RECALL, audited: int = AUDITED, k: int = VECTOR_K,
    themselves: bool = True,
) -> tuple[int, float]:
    """(probes, recall): the fewest probes with which nearest_in_cells() finds a share of `least` or more of the k nearest
    of about `audited` queries, told by an exact scan over all cells; all cells if there is nothing to tell by. Without
    `themselves` a query that is a vector of the index doesn't count as one of its own nearest."""
    cells_ = len(_centres(model))
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(audited)
    hits = _hits_in_cells(model, in_cells, asked, key, vector, cells_, k + (not themselves))
    if not themselves:
        hits = hits.where(F.col("id") != F.col("query_id"))
    by_place = {r["n"]: r["hits"] for r in hits.groupBy("n").agg(F.count("*").alias("hits")).collect()}
    total, found = sum(by_place.values()), 0
    for probes in range(1, cells_ + 1):
        found += by_place.get(probes, 0)
        if total and found >= least * total:
            return probes, found / total
    return cells_, 1.0


class CellIndex:
    """A coarse index that is kept: centres, the vectors stored by cell, and the number of cells to ask.

    It is fitted, placed and audited once, when it is stored; the audit asks vectors of its own (or others that it is given)
    for their nearest ones, themselves left out, and takes the fewest cells that find AUDIT_RECALL of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.versions = spark, folder.rstrip("/"), Versions(spark, folder)

    def store(self, index: DataFrame, key: str, vector: str, k: int = 16, audit: DataFrame | None = None, least: float = AUDIT_RECALL) -> CellIndex:
        """Vectors of another dimension than most have are left out."""
        number, _ = self.versions.last()
        common = index.where(_usable(F.col(vector))).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        if common is None:
            raise ValueError("no vector with a direction")
        index = index.where(_usable(F.col(vector)) & (F.size(vector) == common["dim"]))
        model, at = cells(index, vector, k), f"{self.folder}/cells-{number + 1}"
        placed = assigned(model, index.select(key, vector), vector)
        placed.repartition("cell").sortWithinPartitions("cell", key).write.mode("overwrite").partitionBy("cell").parquet(at)
        asked = (index if audit is None else audit).select(F.col(key).alias("query_id"), F.col(vector).alias("vector"))
        centres = [[float(x) for x in c] for c in model.clusterCenters()]
        probes, recall = audited_probes(centres, self.spark.read.parquet(at), asked, key, vector, least, themselves=False)
        self.versions.commit(number, {"at": at, "key": key, "vector": vector, "centres": centres, "probes": probes, "recall": recall})
        return self

    def state(self) -> dict:
        content = self.versions.last()[1]
        if content is None:
            raise ValueError(f"no index at {self.folder}")
        return content

    def search(self, queries: DataFrame, k: int = VECTOR_K) -> DataFrame:
        """As nearest(), from the cells that the stored number of probes takes."""
        now = self.state()
        return nearest_in_cells(now["centres"], self.spark.read.parquet(now["at"]), queries, now["key"], now["vector"], now["probes"], k)
