"""Approximate nearest neighbours over randomly rotated one-bit codes.

The index holds, for each vector of length one, the signs of its randomly rotated components, packed to bits, and one
correction scalar: its inner product with its own code. Vectors of few components are rotated into BITS dimensions, which
makes estimates sharper. A query's inner product with a vector is estimated from the bits and the scalar; the estimate's
error is below a known multiple of 1/sqrt(bits) but for rare cases. Only codes meet the queries: first to find the best
estimates, whose exact cosines give a k-th best that the true one can't lie below, then to find all vectors whose upper
bound reaches it. Those alone are fetched and ranked again by exact cosines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, ship, small
from .vectors import cosines, matrix, unit, usable

SEED = 20_11
#: Bits of a code at least.
BITS = 256
#: Standard errors that the bound allows; estimates beyond it are rarer than one in ten thousand.
ERRORS = 4.0
#: Bytes that a block's unpacked codes and a block of queries take, about, and vectors below which no block is split.
BLOCK_BYTES, QUERY_BYTES, LEAST_BLOCK = 32 << 20, 8 << 20, 2048
#: Queries estimated, and pairs ranked exactly, at a time: they bound a task's memory.
QUERY_PART, PAIR_PART = 64, 1 << 15
#: Best estimates that are ranked exactly first, as a multiple of k.
FIRST = 4


def bits(dim: int) -> int:
    return max(BITS, -(-dim // 8) * 8)


def rotation(dim: int) -> np.ndarray:
    """Orthogonal columns of a random rotation of bits(dim) dimensions; the same for every index of this dimension."""
    width = bits(dim)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors, and the inner product of each with its code."""
    turned = unit(x) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


class Codes:
    """A block of codes, unpacked once for all queries that meet it."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, dim: int, errors: float = ERRORS):
        width = bits(dim)
        own = np.maximum(scale, 1e-9)
        signs = np.unpackbits(codes, axis=1)[:, :width].astype(np.float32) * 2 - 1
        self.signs = (signs / (np.sqrt(width) * own)[:, None].astype(np.float32)).T
        self.turn = rotation(dim).T
        self.bound = (errors * np.sqrt(np.maximum(1 - own * own, 0)) / own / np.sqrt(width - 1) + 1e-5).astype(np.float32)

    def estimate(self, queries: np.ndarray) -> np.ndarray:
        """Estimated cosines (queries x vectors); the error of column j is at most bound[j], but for rare cases."""
        return (unit(queries) @ self.turn).astype(np.float32) @ self.signs


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dim, code, scale) of every vector that takes part: all usable ones, rows that repeat id and
    vector once. Vectors of several dimensions may lie in one index; only equal dimensions are compared. An empty table
    gives an empty index; other columns are not looked at."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code, scale = np.empty(len(pdf), object), np.zeros(len(pdf))
            dims = pdf["embedding"].map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                packed, scale[at] = encode(matrix(pdf["embedding"].iloc[at], dim))
                for i, row in zip(at, packed):
                    code[i] = row.tobytes()
            yield pdf.assign(dim=dims.astype(np.int32), code=code, scale=scale)

    return rows.mapInPandas(run, "vec_id long, embedding array<double>, dim int, code binary, scale double")


def _block(own: pd.DataFrame, errors: float) -> tuple[np.ndarray, Codes]:
    own = own.sort_values("vec_id", kind="stable")
    codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
    return own["vec_id"].to_numpy(), Codes(codes, own["scale"].to_numpy(), int(own["dim"].iloc[0]), errors)


def _queries(asked: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for at in range(0, len(asked), QUERY_PART):
        part = asked.iloc[at : at + QUERY_PART]
        yield part, matrix(part["embedding"], len(part["embedding"].iloc[0]))


def _best_estimates(own: pd.DataFrame, asked: pd.DataFrame, most: int, errors: float) -> pd.DataFrame:
    """Each query's `most` ids of the best estimates in a block that holds all rows of its ids, by its best row each."""
    ids, codes = _block(own, errors)
    distinct, starts = np.unique(ids, return_index=True)
    out = []
    for part, q in _queries(asked):
        got = codes.estimate(q)
        if len(distinct) < len(ids):
            got = np.maximum.reduceat(got, starts, axis=1)
        q_ids = part["vec_id"].to_numpy()
        got[q_ids[:, None] == distinct[None, :]] = -np.inf
        few = min(most, len(distinct))
        first = np.argpartition(-got, few - 1, axis=1)[:, :few]
        best = np.take_along_axis(got, first, 1)
        r, c = np.nonzero(~np.isneginf(best))
        out.append(pd.DataFrame({"query_id": q_ids[r], "vec_id": distinct[first[r, c]], "estimate": best[r, c].astype(np.float64)}))
    return pd.concat(out)


def _within_bounds(own: pd.DataFrame, asked: pd.DataFrame, errors: float) -> pd.DataFrame:
    """(vec_id, asked_by) for the ids of a block: the queries that one of its rows reaches by its upper bound, given what
    these have already (`enough`). Ids that reach none are left out."""
    ids, codes = _block(own, errors)
    found = []
    for part, q in _queries(asked):
        q_ids = part["vec_id"].to_numpy()
        reach = codes.estimate(q) + codes.bound >= part["enough"].to_numpy()[:, None] - 1e-9
        c, r = np.nonzero(reach.T & (q_ids[None, :] != ids[:, None]))
        found.append((ids[c], q_ids[r]))
    own, by = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((by, own))
    own, by = own[order], by[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (by[1:] != by[:-1])
    own, by = own[new], by[new]
    kept, first = np.unique(own, return_index=True)
    return pd.DataFrame({"vec_id": kept, "asked_by": pd.Series(np.split(by, first[1:]) if len(kept) else [], dtype=object)})


def _kept(i: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best ids, by the best row of each."""
    order = np.lexsort((-cos, ids, i))
    i, ids, cos = i[order], ids[order], cos[order]
    lead = np.ones(len(i), bool)
    lead[1:] = (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])
    i, ids, cos = i[lead], ids[lead], cos[lead]
    order = np.lexsort((ids, -cos, i))
    i, ids, cos = i[order], ids[order], cos[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], ids[best], cos[best]


def _nearest(own: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k nearest of the vectors that it is paired with in a block, by exact cosines."""
    asked = asked.sort_values("vec_id")
    dim = int(asked["dim"].iloc[0])
    q_ids, q = asked["vec_id"].to_numpy(), matrix(asked["embedding"], dim)
    x, ids = matrix(own["embedding"], dim), own["vec_id"].to_numpy()
    times = own["asked_by"].map(len).to_numpy()
    i = np.searchsorted(q_ids, np.concatenate(own["asked_by"].to_list()))
    j = np.repeat(np.arange(len(own)), times)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    waiting, size = [held], 0
    for at in range(0, len(i), PAIR_PART):
        r, c = i[at : at + PAIR_PART], j[at : at + PAIR_PART]
        waiting.append((r, ids[c], cosines(q[r], x[c])))
        size += len(r)
        if size >= 32 * PAIR_PART or at + PAIR_PART >= len(i):
            waiting, size = [_kept(*(np.concatenate(y) for y in zip(*waiting)), k)], 0
    r, c, cos = waiting[0]
    return pd.DataFrame({"query_id": q_ids[r], "vec_id": c, "score": cos})


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        score = np.zeros(len(pdf))
        dims = pdf["q"].map(len).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            score[at] = cosines(matrix(pdf["q"].iloc[at], dim), matrix(pdf["v"].iloc[at], dim))
        yield pd.DataFrame({"query_id": pdf["query_id"], "vec_id": pdf["vec_id"], "score": score})


def search(
    index: DataFrame, queries: DataFrame, k: int = 5, errors: float = ERRORS, vec_id: str = "vec_id", embedding: str = "embedding", scratch: Scratch | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of the index by cosine, ties to the smaller id.

    Candidates with the query's own id are left out. Queries that are null, zero, not finite or without an id get no rows;
    of queries that repeat an id the least vector asks; vectors that repeat an id count once, by their best. Huge and tiny
    components neither overflow nor vanish. An empty index or no query gives no rows.

    Of ids that share one vector only the k + 1 least enter, as no other can be among k nearest. Codes and queries meet in
    blocks, of which each holds all rows of its ids; vectors themselves go only to the pairs that bounds leave over.
    """
    spark = index.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    asked = queries.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    asked = asked.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = scratch.keep(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "queries")
    n = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    index = scratch.keep(index.withColumn("n", n).where(F.col("n") <= k + 1).drop("n"), "candidates")
    count, code_bytes = index.agg(F.count("*"), F.sum(F.octet_length("code"))).first()
    split = min(spark.sparkContext.defaultParallelism, -(-count // LEAST_BLOCK))
    blocks = max(1, split, -(-32 * (code_bytes or 0) // BLOCK_BYTES))
    q_blocks = max(1, -(-8 * (asked.agg(F.sum("dim")).first()[0] or 0) // QUERY_BYTES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = index.select("vec_id", "dim", "code", "scale").withColumn("block", deal(blocks)).withColumn("q_block", every(q_blocks))
    by = ["block", "q_block", "dim"]

    def meet(held: DataFrame, rows: DataFrame, schema: str, task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
        def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if len(a) and len(b):
                got = task(a, b)
            else:
                got = pd.DataFrame({x.split()[0]: np.zeros(0, object if "array" in x else np.int64) for x in schema.split(", ")})
            return got.assign(**dict(zip(by, key)))

        dealt = rows.withColumn("q_block", deal(q_blocks)).withColumn("block", every(blocks))
        return held.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(run, f"{schema}, block int, q_block int, dim int")

    def best(rows: DataFrame, order: str, most: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(order), "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= most)

    first = meet(codes, asked, "query_id long, vec_id long, estimate double", lambda a, b: _best_estimates(a, b, FIRST * k, errors))
    first = best(first, "estimate", FIRST * k).select("query_id", "vec_id", "dim")
    # FIRST * k pairs a query
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = first.join(index.select("vec_id", "dim", F.col("embedding").alias("v")), ["vec_id", "dim"]).join(small(own), "query_id")
    pairs = pairs.select("query_id", "vec_id", "q", "v").mapInPandas(_scored, "query_id long, vec_id long, score double")
    scored = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    enough = best(scored, "score", k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("enough"))
    told = scratch.keep(asked.join(enough, "vec_id", "left").withColumn("enough", F.coalesce("enough", F.lit(-2.0))), "bounds")
    left = scratch.keep(meet(codes, told, "vec_id long, asked_by array<long>", lambda a, b: _within_bounds(a, b, errors)), "left")
    fetched = left.join(index.select("vec_id", "dim", "embedding"), ["vec_id", "dim"])
    hits = meet(fetched, told.drop("enough"), "query_id long, vec_id long, score double", lambda a, b: _nearest(a, b, k))
    return best(hits, "score", k).select("query_id", "rank", "vec_id", "score")
