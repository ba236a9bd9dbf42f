"""Small reads: by ids, by text, by suggested paths; counts of what was left out or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import basename, extension
from ..sources.files import IGNORED_DIRS, IGNORED_FILES


def by_ids(rows: DataFrame, ids: DataFrame, key: str, present: str | None = None) -> DataFrame:
    """rows whose key is among ids (key), with a value in column `present` if it is named."""
    found = rows.join(ids.select(key), key, "left_semi")
    return found if present is None else found.where(F.col(present).isNotNull())


def first_with(rows: DataFrame, column: str, value: str | None, order: str) -> DataFrame:
    """The first row, by `order`, whose column is exactly `value`; none for null or empty values."""
    return rows.where(F.col(column) == F.lit(value) if value else F.lit(False)).orderBy(order).limit(1)


def flattened(name: str, *sources: str) -> Column:
    """A field of a hit from the first of its structs that has it."""
    return F.coalesce(*[F.col(s)[name] for s in sources]).alias(name)


def labelled_files(files: DataFrame) -> DataFrame:
    """Files that are labelled: those of type `code` with a chunk at least."""
    return files.where((F.size("chunks") > 0) & (F.col("file_type") == "code"))


def existing_paths(suggested: DataFrame, files: DataFrame, roots: list[str], by: list[str], most: int = 5) -> DataFrame:
    """(by, n, path): the first `most` suggestions (by, n, item) of each group that exist as they are, or else below the
    first of roots where they do."""
    tries = [F.struct(F.lit(0).alias("root"), F.col("item").alias("path"))]
    below = F.ltrim("item", F.lit("/"))
    tries += [F.struct(F.lit(k).alias("root"), F.concat(F.lit(r.rstrip("/") + "/"), below).alias("path")) for k, r in enumerate(roots, 1)]
    each = suggested.select(*by, "n", F.explode(F.array(*tries)).alias("t")).select(*by, "n", "t.root", "t.path")
    found = each.join(files.select("path").distinct(), "path", "left_semi")
    best = found.groupBy(*by, "n").agg(F.min_by("path", "root").alias("path"))
    place = F.row_number().over(W.partitionBy(*by).orderBy("n"))
    return best.withColumn("place", place).where(F.col("place") <= most).drop("place")


def known_files(suggested: DataFrame, files: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """(by, n, name): the first `most` suggested paths (by, n, item) of each group that are files (by, path, name) by path or
    by base name, as the file's name."""
    asked = suggested.withColumn("name", basename(F.col("item")))
    own = files.groupBy(*by, "name").agg(F.collect_set("path").alias("paths"))
    paths = files.select(*by, F.col("path").alias("item"), F.col("name").alias("by_path")).dropDuplicates([*by, "item"])
    met = asked.join(paths, [*by, "item"], "left").join(own, [*by, "name"], "left").where("by_path is not null or paths is not null")
    place = F.row_number().over(W.partitionBy(*by).orderBy("n"))
    met = met.select(*by, "n", F.coalesce("by_path", "name").alias("name")).withColumn("place", place)
    return met.where(F.col("place") <= most).drop("place")


def ignored_counts(files: DataFrame, path: str = "relative") -> DataFrame:
    """One row: files in all, those in ignored folders, those ignored by name, and the folders that are ignored."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    listed = F.array(*map(F.lit, IGNORED_DIRS))
    at = F.array_position(F.transform(folders, lambda f: F.array_contains(listed, f)), True)
    folder = F.when(at > 0, F.array_join(F.slice(folders, F.lit(1), at.cast("int")), "/"))
    name = F.element_at(parts, -1).isin(*IGNORED_FILES)
    return files.select(folder.alias("folder"), name.alias("by_name")).agg(
        F.count("*").alias("files"), F.count("folder").alias("in_folders"), F.count_if(F.col("by_name") & F.col("folder").isNull()).alias("by_name"),
        F.count_distinct("folder").alias("folders"),
    )


def status_counts(results: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """(by, success, failed, total): how runs ended; every status but success has failed."""
    good = F.coalesce(F.col(status) == "success", F.lit(False))
    counts = [F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), F.count("*").alias("total")]
    return results.groupBy(*by).agg(*counts) if by else results.agg(*counts)


def extension_gap(files: DataFrame, known: tuple[str, ...], path: str = "relative") -> DataFrame:
    """(extension, missing): extensions that files have and `known` hasn't (missing from the list), and the reverse."""
    found = files.select(extension(F.col(path)).alias("extension")).where("extension <> ''").distinct()
    listed = files.sparkSession.createDataFrame([(x,) for x in known], "extension string")
    gap = lambda a, b, where: a.join(b, "extension", "left_anti").select("extension", F.lit(where).alias("missing"))
    return gap(found, listed, "list").unionByName(gap(listed, found, "files")).orderBy("missing", "extension")


def distinct_attempts(attempts: DataFrame, by: list[str], order: str, signature: list[str]) -> DataFrame:
    """Attempts of each group without those that repeat the signature of an earlier one."""
    n = F.row_number().over(W.partitionBy(*by, *signature).orderBy(order))
    return attempts.withColumn("__n", n).where("__n = 1").drop("__n")
