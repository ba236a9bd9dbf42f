"""In-order packing of texts under a length limit, per group. A running sum can't reset in a window, so groups are read in
order and packed as they pass; none is held whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship


def _in_order(rows: DataFrame, by: list[str], *order) -> DataFrame:
    ship(rows.sparkSession)
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def greedy_batches(rows: DataFrame, by: list[str], order: str, size: str, limit: int) -> DataFrame:
    """(by, order, size, batch): in order, a new batch begins where the next item would pass the limit; one that is too
    large alone is still a batch. Null sizes count as 0; items of one place stand by size."""
    kinds = dict(rows.dtypes)
    own = rows.select(*by, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, used = None, 0, 0
        for pdf in batches:
            out = []
            for key, s in zip(zip(*(pdf[c].tolist() for c in by)), pdf[size].tolist()):
                if repr(key) != group:
                    group, batch, used = repr(key), 0, s
                elif used + s > limit:
                    batch, used = batch + 1, s
                else:
                    used += s
                out.append(batch)
            yield pdf.assign(batch=out)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*by, order)] + [f"`{size}` long", "batch int"])
    return _in_order(own, by, order, size).mapInPandas(run, schema)


def batch_sizes(batches: DataFrame, by: list[str], size: str) -> DataFrame:
    """(by, batch, items, total) of what greedy_batches() gives."""
    return batches.groupBy(*by, "batch").agg(F.count("*").alias("items"), F.sum(size).alias("total"))


def digest(rows: DataFrame, by: list[str], order: str, name: str, text: str, per_file: int, total: int, least: int = 500) -> DataFrame:
    """(by, digest): one text per group: files in order under headers, each cut at per_file characters; the first that no
    longer fits is cut to what remains if that is more than `least`, and ends the text. Blank files are left out."""
    kinds = dict(rows.dtypes)
    kept = rows.where(F.length(text) > 0).select(*by, order, F.col(name).alias("__n"), F.substring(text, 1, per_file + 1).alias("__t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, key, whole, done = None, None, "", False
        for pdf in batches:
            out = []
            for at, n, t in zip(zip(*(pdf[c].tolist() for c in by)), pdf["__n"].tolist(), pdf["__t"].tolist()):
                if repr(at) != group:
                    if group is not None:
                        out.append((*key, whole))
                    group, key, whole, done = repr(at), at, "", False
                if done:
                    continue
                head = f"\n=== {n} ===\n"
                body = t[:per_file] + "\n..." if len(t) > per_file else t
                if len(whole) + len(head) + len(body) + 1 <= total:
                    whole += f"{head}{body}\n"
                    continue
                done, room = True, total - len(whole) - len(head)
                if room > least:
                    whole += f"{head}{body[:room]}...\n"
            if out:
                yield pd.DataFrame(out, columns=[*by, "digest"])
        if group is not None:
            yield pd.DataFrame([(*key, whole)], columns=[*by, "digest"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["digest string"])
    return _in_order(kept, by, order, "__n", "__t").drop(order).mapInPandas(run, schema)


def fitted(parts: DataFrame, by: list[str], text: str, total: int) -> DataFrame:
    """parts with texts cut in proportion where a group's are longer than `total` together: each keeps the same share of
    its characters, rounded down."""
    from pyspark.sql import Window as W

    whole = F.sum(F.length(text)).over(W.partitionBy(*by))
    kept = F.floor(F.length(text) * (F.lit(float(total)) / whole)).cast("int")
    return parts.withColumn(text, F.when(whole > total, F.substr(text, F.lit(1), kept)).otherwise(F.col(text)))
