"""Ingestion: gates, insert-if-absent, upsert, property updates, cleaning for migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RELEVANT = 0.9


def gate_class(label: Column, has_evidence: Column, relevance: Column, least: float = RELEVANT) -> Column:
    """`none` without a label; `accepted` with evidence and enough relevance; else `low`. Unknown values count as low."""
    good = F.coalesce(has_evidence & (relevance >= least), F.lit(False))
    return F.when(label.isNull(), "none").when(good, "accepted").otherwise("low")


def passing(labels: Column, least: float = RELEVANT) -> Column:
    """Those of an array of labels (relevance, evidence, ...) that have evidence and enough relevance, in order."""
    return F.filter(labels, lambda x: F.coalesce((x["relevance"] >= least) & (x["evidence"] != ""), F.lit(False)))


def vector_fault(key: Column, text: Column, vector: Column, dim: int) -> Column:
    """Why a row can't enter the index; null if it can."""
    return (
        F.when(F.coalesce(key.cast("string"), F.lit("")) == "", "no id")
        .when(F.coalesce(text, F.lit("")) == "", "no text")
        .when(vector.isNull(), "no vector")
        .when(F.size(vector) != dim, "wrong dimension")
    )


def dimension(rows: DataFrame, vector: str) -> DataFrame:
    """(least, most) dimension: a target can be made only where they are equal."""
    return rows.agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most"))


def keep_last(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return _first(rows, key, [o.desc() for o in order])


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return _first(rows, key, order)


def _first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """existing and those rows of new whose key isn't there; the first of new rows that share one. Nothing is updated."""
    return existing.unionByName(keep_first(new, key, order).join(existing, key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """new rows replace those of their key; of new rows that share one the last wins."""
    last = keep_last(new, key, order).select(*existing.columns)
    return existing.join(last, key, "left_anti").select(*existing.columns).unionByName(last)


def update(existing: DataFrame, changes: DataFrame, key: list[str], column: str, only_null: bool = False) -> DataFrame:
    """existing with a column set from changes (key, column); only_null keeps what is there."""
    found = existing.join(changes.select(*key, F.col(column).alias("__new")).dropDuplicates(key), key, "left")
    first, second = ("__new", column) if not only_null else (column, "__new")
    return found.withColumn(column, F.coalesce(first, second)).select(*existing.columns)


def absent_edges(edges: DataFrame, existing: DataFrame) -> DataFrame:
    return edges.distinct().join(existing, ["src", "dst", "type"], "left_anti")


def todo(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def clean_for_copy(rows: DataFrame, key: str, text: str, vector: str) -> DataFrame:
    """Rows with an id and a vector; the id as text, null texts empty."""
    good = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return good.withColumn(key, F.col(key).cast("string")).withColumn(text, F.coalesce(text, F.lit("")))


def copy_collection(source: DataFrame, target: DataFrame, mode: str, key: list[str], order: list[Column]) -> DataFrame:
    """What a target holds after a copy: `insert` appends, `upsert` replaces by key, `recreate` starts anew, `dry-run`
    changes nothing."""
    modes = {
        "insert": lambda: target.unionByName(source.select(*target.columns)),
        "upsert": lambda: upsert(target, source, key, order),
        "recreate": lambda: source.select(*target.columns),
        "dry-run": lambda: target,
    }
    return modes[mode]()


def merged_results(parts: DataFrame, by: list[str], order: str, ok: str, items: str) -> DataFrame:
    """Results of batches as one: true if any succeeded, the items of those in order."""
    found = F.collect_list(F.struct(order, F.when(F.col(ok), F.col(items)).otherwise(F.slice(items, 1, 0)).alias("x")))
    flat = F.flatten(F.transform(F.sort_array(found), lambda p: p["x"]))
    return parts.groupBy(*by).agg(F.bool_or(ok).alias("result"), flat.alias(items))
