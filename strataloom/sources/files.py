"""Folders, archives, parsed documents and logs as DataFrames."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, extension, is_code
from ..runtime import ship

# What scans skip, and what uploads may be.
IGNORED_DIRS = (
    ".git", ".svn", ".hg", "__pycache__", "node_modules", ".vscode", ".idea", "build", "dist", "target", "bin", "obj", ".pytest_cache",
    ".mypy_cache", "venv", "env", ".env",
)
IGNORED_FILES = (".gitignore", ".gitattributes", ".DS_Store", "Thumbs.db", ".pylintrc", ".flake8", "pytest.ini", "setup.cfg", "tox.ini")
ARCHIVES = (".tar", ".zip", ".7z", ".tar.gz")
DOCUMENTS = (".pdf", ".docx", ".doc", ".txt", ".md", ".pptx", ".jpg", ".png", ".xlsx")
BATCH_DOCUMENTS = (".pdf", ".docx", ".doc", ".txt", ".md")
READMES = ("README.md", "readme.md", "README.txt", "readme.txt")
ENCODINGS = ("utf-8", "gbk", "gb18030", "iso-8859-1")
MAX_BYTES = 1 << 20
#: scan_all opens folders on the driver down to so many levels or until it has so many folders; a batch holds about so many bytes.
LISTED_LEVELS, LISTED_FOLDERS, BATCH_BYTES = 3, 256, 16 << 20

PARSED = T.StructType().add(
    "chunks_list",
    T.ArrayType(
        T.StructType()
        .add("content", T.StringType())
        .add("safe_sign", T.IntegerType())
        .add("metadata", T.StructType().add("chunk_id", T.StringType()).add("chunk_number", T.IntegerType()).add("chunk_type", T.StringType()))
    ),
)


def scan(spark: SparkSession, folder: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, relative_path, name, length, modified[, content]) of files. Without content only metadata is read.
    Empty files, and names that begin with a dot or an underscore, are left out by the reader; scan_all has them."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder if recursive else f"{folder}/*")
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    rel = F.regexp_replace(plain, "^" + _quoted(root), "")
    if not recursive:  # a pattern that names a folder takes the files in it too
        got = got.where(~rel.contains("/"))
    cols = [F.col("path"), rel.alias("relative_path"), basename(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified")]
    return got.select(*cols, *(["content"] if content else []))


def scan_all(spark: SparkSession, folder: str, content: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """scan() of every file below a folder, empty ones and names with a leading dot or underscore among them. Files over
    max_bytes have null content. Folders are opened here until there are enough to deal out; tasks list and read what lies
    below them, through the store that the path names, which the workers must reach too. An empty folder gives no rows."""
    ship(spark)
    store, root = _store(folder)
    root, shown = root.rstrip("/"), folder.rstrip("/") if ":" in folder else "file:" + folder.rstrip("/")
    entries, open_ = [], [root]
    for _ in range(LISTED_LEVELS):
        below = [x for at in open_ for x in store.get_file_info(fs.FileSelector(at))]
        entries += [(x.path, False) for x in below if x.is_file]
        open_ = [x.path for x in below if x.type == fs.FileType.Directory]
        if len(open_) >= LISTED_FOLDERS:
            break
    entries += [(at, True) for at in open_]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = _store(folder)
        for pdf in batches:
            for at, is_folder in zip(pdf["at"], pdf["is_folder"]):
                infos = own.get_file_info(fs.FileSelector(at, recursive=True)) if is_folder else [own.get_file_info(at)]
                rows, held = [], 0
                for x in infos:
                    if x.is_file:
                        body = own.open_input_file(x.path).read() if content and x.size <= max_bytes else None
                        rows.append((x.path[len(root) + 1 :], x.size, x.mtime, body))
                        held += 256 + len(body or b"")
                    if held >= BATCH_BYTES:
                        yield _scanned(rows, shown)
                        rows, held = [], 0
                if rows:
                    yield _scanned(rows, shown)

    dealt = spark.createDataFrame(entries, "at string, is_folder boolean").repartition(max(1, min(len(entries), LISTED_FOLDERS)), "at")
    got = dealt.mapInPandas(run, "path string, relative_path string, name string, length long, modified timestamp, content binary")
    return got if content else got.drop("content")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def _scanned(rows: list[tuple], shown: str) -> pd.DataFrame:
    rel, size, modified, body = map(list, zip(*rows))
    names = [x.rpartition("/")[2] for x in rel]
    times = pd.to_datetime(modified, utc=True).floor("ms")
    return pd.DataFrame({"path": [f"{shown}/{x}" for x in rel], "relative_path": rel, "name": names, "length": size, "modified": times, "content": body})


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_- " else c for c in text)


def not_ignored(relative: Column, hidden: bool = True) -> Column:
    """Whether no folder on the way is ignored and the file isn't either; hidden=False also skips names with a leading dot.
    Only the part below the project's root counts."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ok = ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRS))) & ~F.element_at(parts, -1).isin(*IGNORED_FILES)
    return ok if hidden else ok & ~relative.rlike(r"(^|/)\.")


def code_files(files: DataFrame, max_bytes: int = MAX_BYTES, hidden: bool = True) -> DataFrame:
    """Files that count as source code: by extension, size and place."""
    return files.where((F.col("length") <= max_bytes) & is_code(F.col("relative_path")) & not_ignored(F.col("relative_path"), hidden))


def git_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Folders (project, relative to the given one) that hold `.git`, but none below another. File scans leave out names
    with a leading dot, so folders are listed, on whatever store they are; only their names reach the driver."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, left = [], [(root, "")]
    while left:
        at, name = left.pop()
        below = [x for x in store.listStatus(at) if x.isDirectory()]
        if any(x.getPath().getName() == ".git" for x in below):
            found.append((name,))
        else:
            left += [(x.getPath(), f"{name}/{x.getPath().getName()}".lstrip("/")) for x in below]
    return spark.createDataFrame(sorted(found), "project string")


def subfolders(files: DataFrame) -> DataFrame:
    return files.where(F.col("relative_path").contains("/")).select(F.substring_index("relative_path", "/", 1).alias("folder")).distinct().orderBy("folder")


def allowed(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """files with `accepted` set; the rest is for a table of rejects."""
    return files.withColumn("accepted", extension(F.col("name")).isin(*extensions))


def decoded(content: Column) -> Column:
    """Bytes as text by the first encoding that fits; the last always does. UTF-8 is tried without Python."""

    ship(SparkSession.active())

    @F.pandas_udf("string")
    def others(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: None if b is None else _decode(b))

    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.when(utf8.isNotNull(), utf8).when(content.isNotNull(), others(content))


def _decode(data: bytes) -> str:
    for name in ENCODINGS[:-1]:
        try:
            return bytes(data).decode(name)
        except UnicodeDecodeError:
            continue
    return bytes(data).decode(ENCODINGS[-1])


def readme(files: DataFrame, by: str = "project") -> DataFrame:
    """Each project's README: the first of the known names."""
    rank = F.array_position(F.array(*map(F.lit, READMES)), F.col("name"))
    return files.where(rank > 0).groupBy(by).agg(F.min_by("content", rank).alias("content")).withColumn("readme", decoded(F.col("content"))).drop("content")


def archive_members(archives: DataFrame) -> DataFrame:
    """(archive, member, status, content) of zip, tar and tar.gz archives in `content`. Unsafe member names and archives
    that can't be read or are of another kind give a row with a status and no content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    for name, body in _members(path, bytes(data)):
                        safe = not name.startswith("/") and ".." not in name.split("/")
                        rows.append((path, name, "ok" if safe else "unsafe", body if safe else None))
                except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError) as e:
                    rows.append((path, None, f"unreadable: {type(e).__name__}", None))
                yield pd.DataFrame(rows, columns=["archive", "member", "status", "content"])

    ship(archives.sparkSession)
    return archives.select("path", "content").mapInPandas(run, "archive string, member string, status string, content binary")


def _members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    elif path.lower().endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
    else:
        raise ValueError("unsupported")


def parsed_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, content, safe_sign, chunk_id, chunk_number, chunk_type) of parsed documents; images that were judged
    irrelevant (safe_sign 0) are left out."""
    got = spark.read.schema(PARSED).json(paths, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("chunks_list").alias("pos", "c"))
    rows = got.select("file", "pos", "c.content", "c.safe_sign", "c.metadata.chunk_id", "c.metadata.chunk_number", "c.metadata.chunk_type")
    return rows.where(~(F.coalesce(F.col("chunk_type") == "image", F.lit(False)) & (F.coalesce("safe_sign", F.lit(-1)) == 0)))


def processed_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def append_processed(results: DataFrame, path: str) -> None:
    """Logs what succeeded; what failed stays out and so is tried again."""
    results.where("status = 'success'").select("name").distinct().write.mode("append").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
