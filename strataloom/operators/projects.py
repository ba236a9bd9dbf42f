"""From folders to the base: analysis of projects, ingestion of code and of documents, images, two-level summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import chunking
from ..functions.providers import Providers, project_prompt, prompt
from ..functions.text import basename, fixed_windows, has_text, is_main_name, normal_language, preview, extension, shorten
from ..sources.files import code_files, decoded, readme
from .ingest import passing
from .matching import tree_lines
from .packing import digest, greedy_batches
from .pipelines import WINDOW, analysis_tables, backfill_vectors, document_tables, unique_owners
from .retrieval import TextIndex, text_index

#: Stands for the tactics of a project that no model has told.
NO_TACTICS = ("Command and Control", "TA0011", "")
MAIN_FILES, TACTICS = 10, 3
#: Paths of a project that a model is told of when it is asked for main files.
TOLD_FILES = 200
_TTPS = "array<struct<technique_id:string,name:string,chunk_number:int,relevance:double,have_code:boolean>>"


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", normal_language(F.ltrim(extension(F.col("relative_path")), F.lit("."))))


def main_files(files: DataFrame, suggested: DataFrame | None = None, most: int = MAIN_FILES) -> DataFrame:
    """(project, main_files): suggested names (project, names) where a model gave some, else names that look like it, in order."""
    named = files.where(is_main_name(F.col("relative_path"))).select("project", basename(F.col("relative_path")).alias("name"))
    found = files.select("project").distinct().join(named.groupBy("project").agg(F.sort_array(F.collect_set("name")).alias("main_files")), "project", "left")
    found = found.withColumn("main_files", F.coalesce("main_files", F.array().cast("array<string>")))
    if suggested is not None:
        found = found.join(suggested, "project", "left")
        found = found.withColumn("main_files", F.when(F.size("names") > 0, F.col("names")).otherwise(F.col("main_files"))).drop("names")
    return found.withColumn("main_files", F.slice("main_files", 1, most))


def suggested_files(files: DataFrame, providers: Providers, most: int = TOLD_FILES) -> DataFrame:
    """(project, names): the main files of each project (project, relative_path) that `providers.ask` suggests, in its order, as
    far as they exist; empty where it gives none. It is told the first `most` paths by depth and name, which bounds the prompt."""
    depth = F.size(F.split("relative_path", "/"))
    place = F.row_number().over(W.partitionBy("project").orderBy(depth, "relative_path"))
    told = files.select("project", "relative_path", place.alias("place")).where(F.col("place") <= most)
    told = told.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("place", "relative_path"))).alias("x"))
    asked = prompt("main_files", software_name=F.col("project"), files=F.transform("x", lambda x: x["relative_path"]))
    reply = told.select("project", providers.task(asked, "main_files").alias("r"))
    named = reply.select("project", F.posexplode(F.from_json("r.payload", "main_files array<string>")["main_files"]).alias("pos", "relative_path"))
    there = named.join(files.select("project", "relative_path").distinct(), ["project", "relative_path"], "left_semi")
    kept = there.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("pos", "relative_path"))).alias("x"))
    kept = kept.select("project", F.transform("x", lambda x: x["relative_path"]).alias("names"))
    return told.select("project").join(kept, "project", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def rule_summary(readme_text: Column, names: Column, files: Column) -> Column:
    """A summary without a model: the start of the README, up to five main files, the number of files."""
    head = F.when(has_text(readme_text), F.concat(F.lit("README: "), F.substring(readme_text, 1, 200), F.lit("...")))
    mains = F.when(F.size(names) > 0, F.concat(F.lit("Main files: "), F.array_join(F.slice(names, 1, 5), ", ")))
    return F.concat_ws("; ", head, mains, F.concat(F.lit("Code files: "), files.cast("string")))


def project_chunks(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """(project, relative_path, chunk_number, start_line, end_line, language, chunk, status, error) of source files (project,
    relative_path, length, content). A file that can't be cut keeps a failed row."""
    own = with_language(code_files(files, max_bytes)).withColumn("file", F.struct("project", "relative_path"))
    own = own.select(F.to_json("file").alias("file"), decoded(F.col("content")).alias("text"), "language")
    cut = chunking.chunk_files(own, "file", "text", "language", keep_failed=True)
    at = F.from_json("file", "project string, relative_path string")
    return cut.withColumn("at", at).select("at.*", *[c for c in cut.columns if c != "file"])


def analysed_files(files: DataFrame, providers: Providers, max_bytes: int = 1 << 20, limit: int = WINDOW) -> DataFrame:
    """(project, f) for each source file, f being its entry of an analysis result, from files (project, relative_path, name,
    length, content).

    Files are cut to chunks, packed in order under `limit` characters a batch, and labelled batch by batch by
    `providers.label`; findings without evidence or of low relevance are dropped. A finding belongs to the first chunk of its
    batch that holds its evidence, or else to the first. A file has succeeded if one of its batches has.
    """
    chunks = project_chunks(files, max_bytes)
    sized = chunks.where("status = 'success'").withColumn("size", F.length("chunk"))
    by = ["project", "relative_path"]
    batched = greedy_batches(sized, by, "chunk_number", "size", limit).select(*by, "chunk_number", "batch")
    rows = sized.join(batched, [*by, "chunk_number"])
    told = rows.groupBy(*by, "batch").agg(F.sort_array(F.collect_list(F.struct("chunk_number", "chunk"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(F.lit("#"), x["chunk_number"].cast("string"), F.lit("\n"), x["chunk"])), "\n")
    found = told.select(*by, "batch", "c", providers.labels(text).alias("l"))
    passed = passing(F.col("l.labels"))
    place = lambda x: F.coalesce(F.try_element_at(F.filter("c", lambda k: F.contains(k["chunk"], x["evidence"])), F.lit(1))["chunk_number"], F.col("c")[0]["chunk_number"])
    ttps = F.transform(passed, lambda x: F.struct(x["label_id"].alias("technique_id"), x["evidence"].alias("name"), place(x).alias("chunk_number"), x["relevance"], F.lit(True).alias("have_code")))
    found = found.select(*by, "batch", (F.col("l.status") == "success").alias("ok"), ttps.cast(_TTPS).alias("ttps"))
    per = found.groupBy(*by).agg(F.bool_or("ok").alias("ok"), F.sort_array(F.collect_list(F.struct("batch", "ttps"))).alias("t"))
    per = per.select(*by, F.struct(
        F.col("ok").alias("result"), F.when(F.col("ok"), "success").otherwise("failed").alias("status"),
        F.when(~F.col("ok"), "no batch was labelled").alias("error"), F.flatten(F.transform("t", lambda x: x["ttps"])).alias("ttps"),
    ).alias("file_technique"))
    chunk = F.struct("chunk_number", F.col("chunk").alias("code"), "start_line", "end_line", "language")
    own = chunks.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "success", chunk))).alias("chunks"), F.first("error", ignorenulls=True).alias("error")
    )
    empty = F.struct(F.lit(False).alias("result"), F.lit("failed").alias("status"), F.col("error"), F.array().cast(_TTPS).alias("ttps"))
    return own.join(per, by, "left").select("project", F.struct(
        basename(F.col("relative_path")).alias("file_name"), F.col("relative_path").alias("file_abs_path"),
        F.when(F.size("chunks") > 0, F.col("chunks")).alias("chunks"), F.coalesce("file_technique", empty).alias("file_technique"),
    ).alias("f"))


def analysed_projects(files: DataFrame, providers: Providers, max_bytes: int = 1 << 20) -> DataFrame:
    """(software_name, software_summary, software_tree, software_tactics) of every project. Summary and tactics come from
    `providers.ask`, and where that gives none from rules (rule_summary, NO_TACTICS)."""
    source = code_files(files, max_bytes)
    about = files.select("project").distinct().join(source.groupBy("project").agg(F.count("*").alias("n")), "project", "left")
    about = about.join(main_files(source), "project", "left").join(readme(files.select("project", "name", "content")), "project", "left")
    about = about.join(project_tree(files), "project", "left")
    mains = source.where(is_main_name(F.col("relative_path"))).select("project", "relative_path", decoded(F.col("content")).alias("text"))
    code = digest(mains, ["project"], "relative_path", "relative_path", "text", 5000, 30_000)
    about = about.join(code.withColumnRenamed("digest", "code"), "project", "left")
    ask = lambda task, kind: providers.task(project_prompt(task, F.col("project"), F.lit(None).cast("string"), F.col("readme"), F.col("code"), F.col("tree")), kind)
    about = about.withColumn("s", ask("summary", "summary")).withColumn("t", ask("tactics", "tactics"))
    reply = F.from_json("t.payload", "tactics array<struct<tactic:string,tactic_id:string,evidence:string>>")["tactics"]
    static = F.array(F.struct(*[F.lit(x).alias(k) for k, x in zip(("tactic", "tactic_id", "evidence"), NO_TACTICS)]))
    tactics = F.struct(F.lit("success").alias("status"), F.slice(F.coalesce(reply, static), 1, TACTICS).alias("tactics"))
    rule = rule_summary(F.col("readme"), F.coalesce("main_files", F.array().cast("array<string>")), F.coalesce("n", F.lit(0)))
    return about.select(
        F.col("project").alias("software_name"), F.coalesce(F.get_json_object("s.payload", "$.summary"), rule).alias("software_summary"),
        F.col("tree").alias("software_tree"), tactics.alias("software_tactics"),
    )


def analyse(files: DataFrame, providers: Providers, max_bytes: int = 1 << 20, limit: int = WINDOW) -> DataFrame:
    """Projects as analysis results (ANALYSIS), one row each, as they are exported; a row holds all files of its project, so
    ingest_code() goes without it. A project without source files keeps its row, without files."""
    listed = analysed_files(files, providers, max_bytes, limit).groupBy("project").agg(F.sort_array(F.collect_list("f")).alias("software_files"))
    return analysed_projects(files, providers, max_bytes).join(listed.withColumnRenamed("project", "software_name"), "software_name", "left")


def project_tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(project, tree): the folders and files of each project as one text, down to a depth, in order."""
    lines = tree_lines(files.select(F.concat_ws("/", "project", "relative_path").alias("path")), depth=depth + 1)
    # a line's place: for every folder on the way, folders before files, then names without regard to case
    step = lambda parent, is_file, name: F.concat(F.when(is_file, "1").otherwise("0"), F.lower(name), F.lit("\x01"), name)
    up = F.filter(F.split("parent", "/"), lambda x: x != "")
    folders = F.transform(up, lambda x: F.concat(F.lit("0"), F.lower(x), F.lit("\x01"), x))
    own = lines.where("level > 1").withColumn("place", F.concat(folders, F.array(step(F.col("parent"), F.col("is_file"), F.col("name")))))
    own = own.withColumn("project", F.substring_index("parent", "/", 1)).withColumn("line", F.substr("line", F.lit(5)))
    got = own.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    return got.select("project", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("tree"))


def ingest_code(files: DataFrame, providers: Providers, batch: int = 0, dimension: int | None = None) -> dict[str, DataFrame]:
    """Everything that code adds to the base: the tables of analysis_tables(), `index` (id, text, vector) of the accepted
    chunks that can enter it, `faults` of those that can't, and `projects` (project, status, error): failed where files are
    there and none was labelled, skipped where there is none."""
    told, about = analysed_files(files, providers), analysed_projects(files, providers)
    alone = told.select(F.col("project").alias("software_name"), F.array("f").alias("software_files"))
    head = ["software_summary", "software_tree", "software_tactics"]
    alone = alone.select("*", *[F.lit(None).cast(dict(about.dtypes)[c]).alias(c) for c in head])
    out = analysis_tables(alone, batch, providers.description)
    out["software"] = analysis_tables(about.withColumn("software_files", F.lit(None).cast(dict(alone.dtypes)["software_files"])), batch)["software"]
    accepted = out["code_chunk"].where("class = 'accepted'").withColumn("vector", F.lit(None).cast("array<double>"))
    rows = backfill_vectors(accepted, "description", "vector", providers.embedding)
    ended = told.groupBy("project").agg(F.bool_or(F.col("f.file_technique.status") == "success").alias("good"))
    ended = about.select(F.col("software_name").alias("project")).join(ended, "project", "left")
    status = F.when(F.col("good"), "success").when(~F.col("good"), "failed").otherwise("skipped")
    ended = ended.select("project", status.alias("status"), F.when(~F.col("good"), "no file was labelled").alias("error"))
    return out | _indexed(rows, "code_uuid", "description", dimension) | {"projects": ended}


def _indexed(rows: DataFrame, key: str, text: str, dimension: int | None) -> dict[str, DataFrame]:
    size = F.size("vector") if dimension is None else F.lit(dimension)
    told = rows.withColumn("fault", F.when(F.coalesce(F.col(key), F.lit("")) == "", "no id").when(F.coalesce(F.col(text), F.lit("")) == "", "no text")
        .when(F.col("vector").isNull(), "no vector").when(F.size("vector") != size, "wrong dimension"))
    columns = [F.col(key).alias("id"), F.col(text).alias("text"), "vector"]
    return {"index": told.where("fault is null").select(*columns), "faults": told.where("fault is not null").select(F.col(key).alias("id"), "fault")}


def terms_of(index: DataFrame, folder: str | None = None) -> TextIndex:
    """The words of an index (id, text), stored below `folder` if one is named."""
    found = text_index(index, "id", "text")
    return found.store(folder) if folder else found


def read_images(chunks: DataFrame, providers: Providers) -> DataFrame:
    """Parsed chunks with images judged: one that is relevant gets sign 1 and its text where one is read in it, any other
    sign 0. Other chunks stay as they are."""
    image = F.coalesce(F.col("chunk_type") == "image", F.lit(False))
    picture = F.when(image, F.col("content"))
    told = chunks.withColumn("__good", providers.relevant_image(picture))
    told = told.withColumn("__text", providers.recognised(F.when(F.col("__good"), picture)))
    told = told.withColumn("safe_sign", F.when(image, F.col("__good").cast("int")).otherwise(F.col("safe_sign")))
    return told.withColumn("content", F.coalesce("__text", "content")).drop("__good", "__text")


def parsed_json(chunks: DataFrame) -> DataFrame:
    """(file, json): chunks put together again as parsed documents are stored, in order."""
    meta = F.struct("chunk_id", "chunk_number", "chunk_type")
    item = F.struct("pos", F.struct("content", "safe_sign", meta.alias("metadata")).alias("c"))
    got = chunks.groupBy("file").agg(F.sort_array(F.collect_list(item)).alias("x"))
    return got.select("file", F.to_json(F.struct(F.transform("x", lambda x: x["c"]).alias("chunks_list"))).alias("json"))


def summaries(texts: DataFrame, key: str, text: str, summarise: Callable[[Column], Column], window: int = WINDOW) -> DataFrame:
    """(key, parts, summary): each part of a text is summarised, then what came of them together. Parts that fail are passed
    over; null where all do, or where the whole can't be summarised."""
    parts = texts.select(key, F.posexplode(fixed_windows(F.col(text), window)).alias("pos", "part"))
    told = parts.select(key, "pos", summarise(F.col("part")).alias("s")).where(has_text(F.col("s")))
    whole = told.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("x"))
    whole = whole.select(key, F.size("x").alias("parts"), F.array_join(F.transform("x", lambda x: x["s"]), "\n").alias("all"))
    out = texts.select(key).join(whole.withColumn("summary", summarise(F.col("all"))).drop("all"), key, "left")
    return out.withColumn("parts", F.coalesce("parts", F.lit(0)))


def ingest_documents(parsed: DataFrame, providers: Providers, batch: int = 0, dimension: int | None = None) -> dict[str, DataFrame]:
    """Everything that parsed documents (name, chunk_number, content, chunk_type, safe_sign) add to the base: the tables of
    document_tables(), with images read and summaries of two levels, `index` of their chunks and `faults`."""
    read = read_images(parsed, providers)
    out = document_tables(read, providers.labels, lambda c: F.lit(None).cast("string"), batch)
    whole = out["document"].drop("article_summary")
    told = summaries(whole, "name", "full_text", providers.description).select("name", F.col("summary").alias("article_summary"))
    out["document"] = whole.join(told, "name", "left")
    rows = backfill_vectors(out["document_chunk"].withColumn("vector", F.lit(None).cast("array<double>")), "description", "vector", providers.embedding)
    return out | _indexed(rows, "chunk_id", "description", dimension)


def backfill_document_urls(documents: DataFrame, chunks: DataFrame, index: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, index, shared) with the urls (name, url) of documents set on themselves, on their chunks (by name)
    and on their chunks' rows of the index (by id); names that several documents share are left alone and listed."""
    single, shared = unique_owners(documents, urls)
    own = single.select("name").join(urls.dropDuplicates(["name"]), "name").select("name", F.col("url").alias("__url"))
    put = lambda rows: rows.join(own, "name", "left").withColumn("repo_url", F.coalesce("__url", "repo_url")).drop("__url")
    ids = chunks.join(own, "name").select(F.col("chunk_id").alias("id"), "__url")
    found = index.join(ids, "id", "left").withColumn("url", F.coalesce("__url", "url")).drop("__url")
    return put(documents), put(chunks), found, shared


def trimmed_chunks(chunks: Column, most: int = 5000) -> Column:
    """Chunks as a model is told them: their number and code, long code cut."""
    return F.transform(chunks, lambda c: F.struct(c["chunk_number"].alias("chunk_number"), shorten(c["code"], most).alias("code")))


def technique_prompt(name: Column, summary: Column, tactics: Column, chunks: Column) -> Column:
    return prompt("techniques", software_name=name, summary=preview(summary, 2000), tactics=tactics, chunks=trimmed_chunks(chunks))
