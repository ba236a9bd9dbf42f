"""Matching of suggested names to files, ordinals, trees, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import basename


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(item, path): each wanted item's file by equality, else by a path that ends in it, else by base name; the first path
    of the best rule. Every rule needs equal base names, so one equi-join on that finds all candidates."""
    a = wanted.select("item").distinct().withColumn("base", basename(F.col("item")))
    # a path that many files share is one candidate
    b = files.select("path").distinct().withColumn("base", basename(F.col("path")))
    rule = F.when(F.col("path") == F.col("item"), 0).when(F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("item"))), 1).otherwise(2)
    best = a.join(b, "base").groupBy("item").agg(F.min(F.struct(rule.alias("rule"), "path")).alias("m"))
    return best.select("item", "m.path", "m.rule")


def numbered(rows: DataFrame, order: str, parts: int | None = None, name: str = "number") -> DataFrame:
    """rows with their number, from 0, in ascending order of a numeric column, nulls first; equal values in any order.

    Ranges of about equal size come from approximate quantiles, as constants of the plan; each range is numbered in a task
    of its own and begins where the rows of those before it end. Only one row per range meets in one place.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx(order, at or [0.5])).first()[0] or []))
    part = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
    dealt = rows.withColumn("__part", F.when(F.col(order).isNull(), -1).otherwise(part))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1
    # a row per range
    based = dealt.withColumn("__own", own).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return based.withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def batch_numbers(rows: DataFrame, order: str, size: int, name: str = "batch") -> DataFrame:
    """rows with the number, from 1, of their batch of `size` in one global order."""
    return numbered(rows, order, name=name).withColumn(name, (F.floor(F.col(name) / size) + 1).cast("long"))


def overlap_before(text: Column, by: list[str], order: str, n: int) -> Column:
    """The text with the end of the one before it in its group."""
    before = F.lag(text).over(W.partitionBy(*by).orderBy(order))
    return F.when(before.isNull(), text).otherwise(F.concat(F.right(before, F.lit(n)), F.lit("\n"), text))


def tree_lines(paths: DataFrame, path: str = "path", depth: int = 3) -> DataFrame:
    """(parent, name, is_file, level, line) of folders and files down to a depth: folders first, names without regard to case."""
    parts = paths.select(F.split(path, "/").alias("p"))
    at = F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth)))).alias("level")
    rows = parts.select("p", at).select(
        F.array_join(F.slice("p", 1, F.col("level") - 1), "/").alias("parent"), F.element_at("p", F.col("level")).alias("name"),
        (F.size("p") == F.col("level")).alias("is_file"), "level",
    ).distinct()
    order = W.partitionBy("parent").orderBy("is_file", F.lower("name"), "name")
    last = F.lead("name").over(order).isNull()
    mark = F.when(last, "└── ").otherwise("├── ")
    return rows.withColumn("line", F.concat(F.repeat(F.lit("│   "), F.col("level") - 1), mark, "name"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the right table's last non-null value at or before each row, as `as_of`; one shuffle on the key."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(*by, at, F.col(value).alias("__value"), F.lit(0).alias("__side"))
    line = W.partitionBy(*by).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("as_of", F.last("__value", ignorenulls=True).over(line)).where("__side = 1").drop("__side", "__value")


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points (at: timestamp) with the spans that hold them, ends exclusive. Both meet in buckets of `width` seconds."""
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width * 1_000_000))
    a = points.withColumn("__b", bucket(F.col(at)))
    last = F.floor((F.unix_micros(F.col(end).cast("timestamp")) - 1) / (width * 1_000_000))
    b = spans.where(F.col(start) < F.col(end)).withColumn("__b", F.explode(F.sequence(bucket(F.col(start)), last)))
    return a.join(b, "__b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")
