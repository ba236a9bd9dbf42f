"""Whole ingestion and maintenance plans: analysis results and parsed documents to graph tables, back-fills, statistics.

Each gives DataFrames; nothing runs until they are stored. Matching inside a file or a document happens in expressions over
its arrays, so taking an analysis apart needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import basename, encode_path, extension, fixed_windows, has_text, is_code, stable_id
from ..sources.files import not_ignored
from .graph import mirrored, ordered_text
from .ingest import gate_class, passing, update

#: Result of a project's analysis, as it is read from JSON.
ANALYSIS = """software_name string, software_summary string, software_tree string,
 software_tactics struct<status:string,tactics:array<struct<tactic:string,tactic_id:string,evidence:string>>>,
 software_files array<struct<file_name:string,file_abs_path:string,
  chunks:array<struct<chunk_number:int,code:string,start_line:int,end_line:int,language:string>>,
  file_technique:struct<result:boolean,status:string,error:string,
   ttps:array<struct<technique_id:string,name:string,chunk_number:int,relevance:double,have_code:boolean>>>>>"""
BACK = {"HAS_FILE": "FILE_OF", "HAS_CHUNK": "CHUNK_OF", "HAS_LABEL": "LABEL_OF"}
#: Characters of a document that are labelled at a time.
WINDOW = 25_000


def analysis_tables(results: DataFrame, batch: int = 0, describe: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """software, file, code_chunk and edges (src, dst, type) of analysis results (ANALYSIS).

    Ids come from names and places, so a repeated run makes the same rows. Blank chunks are left out. A chunk has the last
    finding of its number, if the file's labelling succeeded; `class` is that of gate_class, and only accepted chunks are
    described and linked to a label. Files without chunks keep their row, projects without files theirs.
    """
    owner = stable_id("software", F.col("software_name")).alias("software_uuid")
    found = F.coalesce("software_tactics.tactics", F.expr("array()").cast("array<struct<tactic:string,tactic_id:string,evidence:string>>"))
    software = results.select(
        owner, F.col("software_name").alias("name"), F.col("software_summary").alias("description"),
        F.transform(found, lambda x: x["tactic_id"]).alias("tactic_id_list"), F.lit(batch).alias("insert_number"),
    )
    each = results.select(owner, "software_name", F.posexplode("software_files").alias("i", "f"))
    file_id = stable_id("file", F.col("software_name"), F.col("i"), F.col("f.file_name"), F.col("f.file_abs_path")).alias("file_uuid")
    file = each.select(file_id, F.col("f.file_name").alias("name"), "software_uuid", F.lit(batch).alias("insert_number"))
    good = (F.col("f.file_technique.status") == "success") & F.col("f.file_technique.result")
    opened = each.select(file_id, F.when(good, F.col("f.file_technique.ttps")).alias("ttps"), F.posexplode("f.chunks").alias("k", "c"))
    opened = opened.where(has_text(F.col("c.code")))
    own = opened.withColumn("t", F.try_element_at(F.filter("ttps", lambda t: t["chunk_number"] == F.col("c.chunk_number")), F.lit(-1)))
    have = F.coalesce("t.have_code", F.lit(False))
    chunk = own.select(
        stable_id("code", F.col("file_uuid"), F.col("k")).alias("code_uuid"), "file_uuid", F.col("c.code").alias("code_data"),
        F.col("c.start_line").alias("chunk_start_line"), F.col("c.end_line").alias("chunk_end_line"), F.col("t.technique_id").alias("technique_id"),
        F.col("t.relevance").alias("relevance"), have.alias("have_code"), gate_class(F.col("t.technique_id"), have, F.col("t.relevance")).alias("class"),
        F.lit(batch).alias("insert_number"),
    )
    told = F.lit(None).cast("string") if describe is None else describe(F.when(F.col("class") == "accepted", F.col("code_data")))
    chunk = chunk.withColumn("description", told)
    edge = lambda rows, a, b, kind: rows.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"))
    forward = edge(file, "software_uuid", "file_uuid", "HAS_FILE").unionByName(edge(chunk, "file_uuid", "code_uuid", "HAS_CHUNK"))
    forward = forward.unionByName(edge(chunk.where("class = 'accepted'"), "code_uuid", "technique_id", "HAS_LABEL"))
    return {"software": software, "file": file, "code_chunk": chunk, "edges": mirrored(forward, BACK)}


def unmatched_findings(results: DataFrame) -> DataFrame:
    """(software_name, file_name, chunk_number, technique_id, n): findings of analysis results (ANALYSIS) that name no chunk with
    text of their file, and so reach no table; n counts repeats. Files without chunks have all of theirs listed."""
    each = results.select("software_name", F.explode("software_files").alias("f"))
    there = F.transform(F.filter("f.chunks", lambda c: has_text(c["code"])), lambda c: c["chunk_number"])
    each = each.select("software_name", "f.file_name", F.coalesce(there, F.array().cast("array<int>")).alias("there"), F.explode("f.file_technique.ttps").alias("t"))
    lost = each.where(~F.coalesce(F.array_contains("there", F.col("t.chunk_number")), F.lit(False)))
    return lost.groupBy("software_name", "file_name", "t.chunk_number", "t.technique_id").agg(F.count("*").alias("n"))


def document_tables(
    parsed: DataFrame, label: Callable[[Column], Column], summarise: Callable[[Column], Column], batch: int = 0, window: int = WINDOW
) -> dict[str, DataFrame]:
    """document, document_chunk and edges of parsed rows (name, chunk_number, content, chunk_type, safe_sign).

    Images judged irrelevant (sign 0) are dropped; a missing sign keeps them. A document's text is its chunks in order; it
    is labelled window by window by `label` (struct(status, labels)) and has the labels that pass, in order, repeats kept.
    """
    kept = parsed.where(~((F.coalesce("chunk_type", F.lit("")) == "image") & (F.coalesce("safe_sign", F.lit(1)) == 0)))
    whole = ordered_text(kept, ["name"], "chunk_number", "content", "", "full_text").withColumn("source_info", F.concat(F.lit("userUpload-"), "name"))
    parts = whole.select("name", F.posexplode(fixed_windows(F.col("full_text"), window)).alias("pos", "part"))
    found = parts.select("name", "pos", label(F.col("part"))["labels"].alias("l"))
    passed = F.transform(passing(F.col("l")), lambda x: x["label_id"])
    per = found.select("name", "pos", passed.alias("ids")).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("x"))
    per = per.select("name", F.flatten(F.transform("x", lambda x: x["ids"])).alias("label_ids"))
    document = whole.join(per, "name", "left").withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<string>")))
    document = document.withColumn("article_summary", summarise(F.col("full_text"))).withColumn("insert_number", F.lit(batch))
    chunk = kept.select(
        stable_id("chunk", F.col("name"), F.col("chunk_number")).alias("chunk_id"), "name", F.col("chunk_number").alias("chunk_index"),
        F.col("content").alias("description"), F.concat(F.lit("userUpload-"), "name").alias("source_info"), F.lit(batch).alias("insert_number"),
    )
    forward = chunk.select(F.col("name").alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_CHUNK").alias("type"))
    labelled = document.select(F.col("name").alias("src"), F.explode(F.array_distinct("label_ids")).alias("dst"), F.lit("HAS_LABEL").alias("type"))
    return {"document": document, "document_chunk": chunk, "edges": mirrored(forward.unionByName(labelled), BACK)}


def backfill_vectors(nodes: DataFrame, text: str, vector: str, embed: Callable[[Column], Column]) -> DataFrame:
    """nodes with vectors where there was text and none yet. No shuffle; texts that have a vector aren't sent to the model."""
    return nodes.withColumn(vector, F.coalesce(vector, embed(F.when(F.col(vector).isNull(), F.col(text)))))


def unique_owners(owners: DataFrame, wanted: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(those of owners whose name is wanted and theirs alone, rows (name, n) of names that several share)."""
    counts = owners.join(wanted.select(name).distinct(), name, "left_semi").groupBy(name).agg(F.count("*").alias("n"))
    return owners.join(counts.where("n = 1"), name, "left_semi"), counts.where("n > 1")


def backfill_urls(owners: DataFrame, files: DataFrame, urls: DataFrame, paths: DataFrame, owner_id: str, branch: str = "main") -> tuple[DataFrame, DataFrame]:
    """(files with their urls set, names left alone because several owners share them).

    urls: (name, url) per owner; paths: (name, path) of the owner's stored files, met by base name, the first path by order
    wins. Files of other owners and files without a path stay as they are.
    """
    single, shared = unique_owners(owners, urls)
    stored = paths.withColumn("base", basename(F.col("path"))).groupBy("name", "base").agg(F.min("path").alias("path"))
    at = single.select(owner_id, "name").join(urls.dropDuplicates(["name"]), "name").join(stored, "name")
    link = F.concat_ws("/", F.rtrim(F.col("url"), F.lit("/")), F.lit("src/branch"), F.lit(branch), encode_path(F.col("path")))
    changes = at.select(owner_id, F.col("base").alias("__base"), link.alias("repo_url"))
    out = files.withColumn("__base", basename(F.col("name")))
    return update(out, changes, [owner_id, "__base"], "repo_url").drop("__base"), shared


def file_statistics(files: DataFrame, path: str = "relative") -> DataFrame:
    """(extension, kept, n, share): files by extension, most frequent first; kept are source files outside ignored folders.
    share is the percentage among files of the same `kept`, to one decimal."""
    kept = not_ignored(F.col(path)) & is_code(F.col(path))
    counts = files.groupBy(extension(F.col(path)).alias("extension"), kept.alias("kept")).agg(F.count("*").alias("n"))
    # one row per extension passes through the window
    share = F.round(F.lit(100) * F.col("n").cast("decimal(20,1)") / F.sum("n").over(W.partitionBy("kept")), 1).cast("double")
    return counts.withColumn("share", share).orderBy(F.desc("n"), "extension", "kept")
