"""An inverted index that takes changes: segments that are written once, marks of what is deleted, tiered merges.

A segment puts its documents into groups as they lie. For each term and group with it there is one row: the postings in arrays,
beside their number and the pairs of term frequency and length of which no other is better in both. The best of these is the
most that the term adds to the score of any document of the group, so a search sums these bounds per group, scores as many of
the best groups as it wants hits, and then only those others whose bound reaches the k-th score found. Documents come in, change and go by ids; a version names the segments and deletions
that are in force, so that readers see one state. All corpus figures (documents, lengths, document frequencies) count what
is in force only: a search gives the scores of an index built anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import words
from ..runtime import ship
from .retrieval import B, DIGITS, K1, TEXT_K, normalised, top
from .versions import Versions

#: Documents in a group, about; folders over which the terms of a segment are dealt; terms that a search hands to the scan as
#: a filter; rows of ids or terms that are broadcast at most.
GROUP_DOCS, FOLDERS, FILTER_TERMS, SENT_ROWS = 64, 16, 2000, 200_000
#: Scores of a document for a question that one task of a search sums, and words whose postings a task of a segment sorts at a
#: time, about.
PAIRS, TASK_WORDS = 1 << 20, 1 << 19
#: Bytes that a task holds of each folder's file before it writes them.
FILE_BYTES = 8 << 20
#: Spark keeps the files of so many folders open in a task, instead of sorting its rows by folder.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Segments of one size class that are merged into one of the next.
FANOUT = 4


@dataclass(frozen=True)
class Snapshot:
    """The segments and deletions of one version."""

    number: int
    segments: list[dict]
    deletions: list[dict]


class KeptIndex:
    """docs are rows (key, text); keys are unique among those in force, null keys and null texts are passed over. `analyse`
    cuts texts and questions into terms; an index is read with what it was made with."""

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "bigint", analyse: Callable[[Column], Column] = words):
        self.spark, self.folder, self.key_type, self.analyse = spark, folder.rstrip("/"), key_type, analyse
        self.versions = Versions(spark, self.folder)

    def snapshot(self) -> Snapshot:
        number, content = self.versions.last()
        content = content or {"segments": [], "deletions": []}
        return Snapshot(number, content["segments"], content["deletions"])

    # --- changes ---------------------------------------------------------------------------------------------------

    def upsert(self, docs: DataFrame, key: str, text: str) -> None:
        """Adds documents as one segment; those in force with the same key go. Of rows that share a key one stays."""
        now = self.snapshot()
        cut = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        # only keys travel, if each is there once
        if cut.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            cut = cut.dropDuplicates([key])
        cut = cut.select(F.col(key).cast(self.key_type).alias("id"), self.analyse(F.col(text)).alias("w"))
        ship(self.spark)
        segment = self._store(cut.mapInArrow(_held, f"id {self.key_type}, dl int, terms array<string>, tfs array<int>"), 0)
        gone = self._deleted(now, self._docs([segment])) if now.segments else None
        self._commit(now, [*now.segments, segment], [*now.deletions, *([gone] if gone else [])])

    def delete(self, keys: DataFrame, key: str) -> None:
        """Takes documents out by key; unknown keys do nothing."""
        now = self.snapshot()
        gone = self._deleted(now, keys.select(F.col(key).cast(self.key_type).alias("id")).where("id is not null").distinct())
        if gone:
            self._commit(now, now.segments, [*now.deletions, gone])

    def merge(self, fanout: int = FANOUT) -> bool:
        """Merges the oldest `fanout` segments of a size class into one of the next, if there are as many; what is deleted
        is dropped for good. Lists of terms are read, texts are not."""
        now = self.snapshot()
        levels: dict[int, list[dict]] = {}
        for s in now.segments:
            levels.setdefault(s["level"], []).append(s)
        ready = next((own[:fanout] for _, own in sorted(levels.items()) if len(own) >= fanout), None)
        if ready is None:
            return False
        names = {s["name"] for s in ready}
        part = Snapshot(now.number, ready, now.deletions)
        # lists of terms travel only if many documents are deleted
        few = sum(c[0] for d in now.deletions for name, c in d["counts"].items() if name in names) <= SENT_ROWS
        gone = F.broadcast(self._gone(part)) if few else self._gone(part).hint("shuffle_hash")
        held = self._read(ready, "forward", "id, dl, terms, tfs").join(gone, ["segment", "id"], "left_anti")
        merged = self._store(held.drop("segment"), ready[0]["level"] + 1)
        # deletions of other segments stay; those of the merged ones have taken effect
        rest = [dict(d, segments=[s for s in d["segments"] if s not in names]) for d in now.deletions]
        self._commit(now, [*(s for s in now.segments if s["name"] not in names), merged], [d for d in rest if d["segments"]])
        return True

    def vacuum(self) -> list[str]:
        """Deletes folders that the last version doesn't name: failed or merged ones. Not while others write or read."""
        now = self.snapshot()
        named = {s["name"] for s in now.segments} | {d["name"] for d in now.deletions}
        stray = [n for kind in ("segments", "deletions") for n in self.versions.list(f"{self.folder}/{kind}") if n not in named]
        for kind in ("segments", "deletions"):
            for n in stray:
                self.versions.delete(f"{self.folder}/{kind}/{n}")
        self.versions.delete(f"{self.folder}/searches")
        self.versions.forget(1)
        return stray

    def _commit(self, now: Snapshot, segments: list[dict], deletions: list[dict]) -> None:
        self.versions.commit(now.number, {"segments": segments, "deletions": deletions})

    def _store(self, held: DataFrame, level: int) -> dict:
        """Writes a segment from (id, dl, terms, tfs). Each text is cut once, and its list of terms is what all else is made of:
        postings are grouped where the lists lie, sorted there by term, some at a time, and written; none travels."""
        name = uuid.uuid4().hex
        at = f"{self.folder}/segments/{name}"
        # the row's number in its task, which holds whole groups of rows that lie together
        group = F.shiftright(F.monotonically_increasing_id(), GROUP_DOCS.bit_length() - 1)
        held.select("id", F.col("dl").cast("int").alias("dl"), "terms", "tfs").withColumn("grp", group).write.option("compression", "zstd").parquet(f"{at}/forward")
        segment = {"name": name, "level": level}
        n, length = self._docs([segment]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        listed = self._read([segment], "forward", "id, dl, terms, tfs, grp").drop("segment")
        ship(self.spark)
        listed = listed.mapInArrow(partial(_sorted, most=TASK_WORDS), f"term string, {self._kinds('postings').removeprefix('term string, ').removesuffix(', folder int')}")
        dealt = listed.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
        was = self.spark.conf.get(OPEN_FILES)
        self.spark.conf.set(OPEN_FILES, FOLDERS)
        try:
            dealt.write.options(**{"compression": "zstd", "parquet.block.size": FILE_BYTES}).partitionBy("folder").parquet(f"{at}/postings")
        finally:
            self.spark.conf.set(OPEN_FILES, was)
        return segment | {"docs": n, "words": int(length), "terms": n > 0}

    def _deleted(self, now: Snapshot, ids: DataFrame) -> dict | None:
        """Writes the marks of ids in force, and how much less each term occurs without them."""
        name = uuid.uuid4().hex
        at = f"{self.folder}/deletions/{name}"
        found = self._docs(now.segments).join(self._gone(now), ["segment", "id"], "left_anti").join(ids.select("id"), "id", "left_semi")
        found.select("segment", "id", "dl").write.parquet(f"{at}/docs")
        found = self.spark.read.parquet(f"{at}/docs")
        docs, length = found.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not docs:
            self.versions.delete(at)
            return None
        marked = found.select("segment", "id")
        # the smaller side is held, so that no list of terms is sorted
        marked = F.broadcast(marked) if docs <= SENT_ROWS else marked.hint("shuffle_hash")
        held = self._read(now.segments, "forward", "id, terms").join(marked, ["segment", "id"])
        less = held.select("segment", F.explode("terms").alias("term")).groupBy("segment", "term").agg(F.count("*").alias("less"))
        less.write.parquet(f"{at}/terms")
        hit = sorted(r["segment"] for r in found.select("segment").distinct().collect())
        counts = {r["segment"]: [r["n"], r["w"]] for r in found.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("w")).collect()}
        return {"name": name, "segments": hit, "counts": counts}

    # --- reading ---------------------------------------------------------------------------------------------------

    def _kinds(self, kind: str) -> str:
        if kind == "postings":
            return f"term string, grp bigint, n bigint, best array<struct<tf: int, dl: int>>, postings array<struct<id: {self.key_type}, tf: int, dl: int>>, folder int"
        return f"id {self.key_type}, dl int, terms array<string>, tfs array<int>, grp bigint"

    def _read(self, segments: list[dict], kind: str, columns: str) -> DataFrame:
        out = None
        for s in segments:
            own = self.spark.read.schema(self._kinds(kind)).parquet(f"{self.folder}/segments/{s['name']}/{kind}")
            own = own.select(F.lit(s["name"]).alias("segment"), *columns.split(", "))
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], f"segment string, {self._kinds(kind)}").select("segment", *columns.split(", "))

    def _docs(self, segments: list[dict]) -> DataFrame:
        return self._read(segments, "forward", "id, dl")

    def _rows(self, segments: list[dict]) -> DataFrame:
        return self._read(segments, "postings", "term, grp, n, best, postings, folder")

    def _marks(self, now: Snapshot, kind: str, schema: str) -> DataFrame:
        out = None
        for d in now.deletions:
            own = self.spark.read.schema(schema).parquet(f"{self.folder}/deletions/{d['name']}/{kind}")
            own = own.where(F.col("segment").isin(d["segments"]))
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def _gone(self, now: Snapshot) -> DataFrame:
        return self._marks(now, "docs", f"segment string, id {self.key_type}, dl int").select("segment", "id")

    def size(self, now: Snapshot | None = None) -> tuple[int, int]:
        """(documents, words) in force: sums of what versions note."""
        now = now or self.snapshot()
        named = {s["name"] for s in now.segments}
        gone = [c for d in now.deletions for s, c in d["counts"].items() if s in named and s in d["segments"]]
        return sum(s["docs"] for s in now.segments) - sum(c[0] for c in gone), sum(s["words"] for s in now.segments) - sum(c[1] for c in gone)

    def frequencies(self, terms: DataFrame, now: Snapshot | None = None) -> DataFrame:
        """(term, df) of the asked terms (term): documents in force that hold them."""
        now = now or self.snapshot()
        return self._counted(now, terms, self._wanted(now, terms))

    def _counted(self, now: Snapshot, terms: DataFrame, rows: DataFrame) -> DataFrame:
        held = rows.select("term", "n")
        if now.deletions:
            less = self._marks(now, "terms", "segment string, term string, less bigint").join(terms.select("term"), "term", "left_semi")
            held = held.unionByName(less.select("term", (-F.col("less")).alias("n")))
        return held.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def _wanted(self, now: Snapshot, terms: DataFrame) -> DataFrame:
        """Rows of the asked terms: by a filter that reaches the scan if they are few, else by a join."""
        rows = self._rows(now.segments)
        few = [r["term"] for r in terms.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
        if len(few) > FILTER_TERMS:
            own = terms.select("term").distinct()
            return rows.join(F.broadcast(own) if own.limit(SENT_ROWS + 1).count() <= SENT_ROWS else own, "term", "left_semi")
        folders = self.spark.createDataFrame([(t,) for t in few], "term string").select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")).distinct()
        return rows.where(F.col("folder").isin([r[0] for r in folders.collect()]) & F.col("term").isin(few))

    def plan(self, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hits of the first groups, groups that are left to score, all groups): the parts of a search, for tests too."""
        now = self.snapshot()
        docs, length = self.size(now)
        average = length / docs if docs else 1.0
        impact = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (average or 1.0)))
        asked = self._stored(queries.select("query_id", F.explode(F.array_distinct(self.analyse(F.col("question")))).alias("term")))
        rows = self._wanted(now, asked)
        df = self._counted(now, asked, rows)
        weight = self._stored(asked.join(df, "term").withColumn("idf", F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))))
        # weights go to the rows, if they are few: a row travels once, to where all of its group are, whoever asks for it
        few = weight.limit(SENT_ROWS + 1).count() <= SENT_ROWS
        sent = F.broadcast(weight) if few else weight
        asking = weight.select("query_id").distinct().count()
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-docs * asking // PAIRS))
        # one number for a segment and a group of it, by which rows are dealt
        names = [g["name"] for g in now.segments]
        number = lambda segment: F.array_position(F.array(*map(F.lit, names)), segment) - 1
        rows = rows.withColumn("at", F.col("grp") * len(names) + number(F.col("segment")) if names else F.col("grp"))
        most = F.array_max(F.transform("best", lambda p: impact(p["tf"], p["dl"]))).alias("most")
        bounds = rows.select("term", "at", most).repartition(tasks, "at").join(sent, "term")
        groups = bounds.groupBy("query_id", "at").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "at"))
        groups = self._stored(groups.withColumn("place", place))

        def hits(of: DataFrame) -> DataFrame:
            wanted = of.select("query_id", "at").repartition(tasks, "at")
            wanted = wanted.groupBy("at").agg(F.collect_list("query_id").alias("by")).hint("shuffle_hash")
            found = rows.select("term", "at", "postings").repartition(tasks, "at").join(wanted, "at")
            found = found.join(sent, (found["term"] == sent["term"]) & F.array_contains("by", sent["query_id"]))
            each = found.select("query_id", "at", "idf", F.explode("postings").alias("p"))
            each = each.select("query_id", "at", F.col("p.id").alias("id"), (F.col("idf") * impact(F.col("p.tf"), F.col("p.dl"))).alias("part"))
            # one document of those with an id is in force; all its postings are in its group, so that sums make no shuffle
            each = each.groupBy("query_id", "at", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
            if now.deletions:
                gone = self._gone(now).select(number(F.col("segment")).alias("nr"), "id")
                each = each.withColumn("nr", F.col("at") % len(names)).join(gone.hint("shuffle_hash"), ["nr", "id"], "left_anti")
            return each.select("query_id", "id", "score")

        first = top(hits(groups.where(F.col("place") <= k)), k, F.desc("score"), F.asc("id"))
        first = self._stored(first)
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        left = groups.where(F.col("place") > k).join(least, "query_id", "left")
        # a bound may fall short of a score by rounding only
        left = left.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS))
        return first, hits(left), groups.join(left.select("query_id", "at", F.lit(True).alias("again")), ["query_id", "at"], "left")

    def _stored(self, rows: DataFrame) -> DataFrame:
        """Written below `searches`, which vacuum() empties, and read back: a few rows a query, which are read twice."""
        at = f"{self.folder}/searches/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def search(self, queries: DataFrame, k: int = TEXT_K, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, rank, id, score, normalised): as retrieval.bm25() over an index of the documents in force."""
        first, rest, _ = self.plan(queries, k, k1, b)
        return normalised(top(first.drop("rank").unionByName(rest), k, F.desc("score"), F.asc("id")))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, terms, tfs) of (id, w): a document's number of words, its distinct words and how often each occurs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("w")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        doc, code = np.repeat(np.arange(len(sizes)), sizes), pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        kinds = max(1, len(coded.dictionary))
        pairs, tf = np.unique((doc * kinds + code)[code >= 0], return_counts=True)
        offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) * kinds).astype(np.int32)
        terms = coded.dictionary.take(pa.array(pairs % kinds)) if len(pairs) else pa.array([], pa.string())
        columns = [batch.column("id"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "dl", "terms", "tfs"])


def _sorted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of _posted() in the order of terms and groups, those of about `most` words at a time."""
    own, words_ = [], 0
    for rows, n in _posted(batches):
        own.append(rows)
        words_ += n
        if words_ >= most:
            yield from _in_order(own)
            own, words_ = [], 0
    if own:
        yield from _in_order(own)


def _in_order(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    yield from rows.take(pc.sort_indices(rows, [("term", "ascending"), ("grp", "ascending")])).to_batches(1 << 14)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(term, grp, n, best, postings) of (id, dl, terms, tfs, grp), and their words: the postings of each group of a batch. A group that two
    batches share has two rows for a term, whose bounds add up to one that holds for both."""
    for batch in batches:
        grp = batch.column("grp").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            own = batch.slice(a, b - a)
            own = own.take(pc.sort_indices(own.column("id")))  # postings are in the order of ids
            sizes = pc.list_value_length(own.column("terms")).to_numpy(zero_copy_only=False)
            coded = own.column("terms").flatten().dictionary_encode()
            if not len(coded):
                continue
            doc, code = np.repeat(np.arange(b - a), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            tf, dl = own.column("tfs").flatten().to_numpy(zero_copy_only=False), own.column("dl").to_numpy(zero_copy_only=False)[doc]
            order = np.argsort(code, kind="stable")
            offsets = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
            posting = pa.StructArray.from_arrays([own.column("id").take(pa.array(doc[order])), pa.array(tf[order]), pa.array(dl[order])], names=["id", "tf", "dl"])
            # of those with as many occurrences or more, the shortest so far is passed: lengths of later terms are lowered
            # below all before, so that the least so far begins anew with each term
            best = np.lexsort((dl, -tf, code))
            low = dl[best] - code[best] * (int(dl.max()) + 1)
            keep = np.concatenate([[True], low[1:] < np.minimum.accumulate(low)[:-1]])
            best = best[keep]
            starts = np.searchsorted(code[best], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(tf[best]), pa.array(dl[best])], names=["tf", "dl"])
            n = np.diff(offsets).astype(np.int64)
            columns = [coded.dictionary, pa.array(np.full(len(n), grp[a])), pa.array(n), pa.ListArray.from_arrays(starts, pairs), pa.ListArray.from_arrays(offsets, posting)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "grp", "n", "best", "postings"]), int(pc.sum(own.column("dl")).as_py())
