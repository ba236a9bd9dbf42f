"""Near-duplicate vectors: hierarchical navigable small-world graphs per shard, every shard asked for every vector.

Equal vectors are one node first. Each shard's graph is built once and stored; blocks of vectors then ask every shard. A
beam is as narrow as audits allow: when a graph is built it has to find nodes again from probes turned away from them by
the threshold's angle, and when a block of vectors asks, the links that an exact scan gives for some of them, themselves
left out. So no audit is without links. A beam widens for a shard or a block until its audit passes, and for a single
query while it is full of links; where the widest does not do, the shard is scanned. Links are verified by cosine in
double precision, counted, and joined to components; only counts and spanning stars leave a task, never all pairs of a
group.
"""

from __future__ import annotations

import io
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .vectors import cosines, matrix, unit, usable

THRESHOLD = 0.95
#: Shards at least; more where a shard's vectors and neighbours would take more than SHARD_BYTES.
SHARDS, SHARD_BYTES = 3, 64 << 20
#: Vectors that ask a shard in one task, in bytes: about as many as it holds, so that what is sent is least.
QUERY_BYTES = 32 << 20
#: Neighbours a node keeps above the ground layer (twice as many on it), and the beam for building.
DEGREE, BUILD_BEAM = 16, 32
#: The narrowest and widest beam, probes of a graph and queries of a block that an audit takes, and the recall it asks for.
BEAM, WIDEST, PROBES, AUDITED, RECALL = 16, 512, 400, 48, 0.995
#: Queries searched or scanned at a time.
PART = 512

log = logging.getLogger(__name__)


class Graph:
    """Layers of neighbours over rows of unit vectors. Rows stand in descending order of their top layer, so a layer's
    nodes are a prefix and row 0 is where every search enters."""

    def __init__(self, x: np.ndarray, adjacent: list[np.ndarray]):
        self.x, self.adjacent = x, adjacent

    @classmethod
    def build(cls, x: np.ndarray, seed: int, degree: int = DEGREE, beam: int = BUILD_BEAM, batch: int = 256) -> tuple[Graph, np.ndarray]:
        """The graph and the order in which it holds the rows of x."""
        n = len(x)
        tops = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int), 8)
        order = np.argsort(-tops, kind="stable")
        tops, x = tops[order], np.ascontiguousarray(x[order], np.float32)
        sizes = [int((tops >= layer).sum()) for layer in range(int(tops[0]) + 1)] if n else []
        self = cls(x, [np.full((size, degree * (1 if layer else 2)), -1, np.int32) for layer, size in enumerate(sizes)])
        bounds = [0, 1, *sizes, *range(0, n, batch), *(min(n, 2**k) for k in range(1, 9))]
        bounds = sorted({b for b in bounds if b <= n} | {n})
        for a, b in zip(bounds, bounds[1:]):
            self._insert(a, b, int(tops[a]), degree, beam)
        return self, order

    def _insert(self, a: int, b: int, top: int, degree: int, beam: int) -> None:
        q = self.x[a:b]
        entry = np.zeros((b - a, 1), np.int64)
        within = q @ q.T
        within[np.triu_indices(b - a)] = -np.inf
        for layer in range(len(self.adjacent) - 1, -1, -1):
            there = min(a, len(self.adjacent[layer]))
            if there == 0:
                ids, sims = np.full((b - a, 1), -1, np.int64), np.full((b - a, 1), -np.inf, np.float32)
            else:
                ids, sims = self.beam(q, entry, beam if layer <= top else 4, layer)
                entry = ids
            if layer > top:
                continue
            near = np.argsort(-within, axis=1)[:, : 2 * degree]
            all_ids = np.concatenate([ids, near + a], 1)
            all_sims = np.concatenate([sims, np.take_along_axis(within, near, 1)], 1)
            all_ids[np.isneginf(all_sims)] = -1
            cap = self.adjacent[layer].shape[1]
            chosen = self._diverse(all_ids, all_sims, degree)
            self.adjacent[layer][a:b, : chosen.shape[1]] = chosen
            src, col = np.nonzero(chosen >= 0)
            self._link_back(layer, chosen[src, col].astype(np.int64), src + a, cap)
            if there == 0:
                entry = np.zeros((b - a, 1), np.int64)

    def _link_back(self, layer: int, to: np.ndarray, new: np.ndarray, cap: int) -> None:
        if not len(to):
            return
        adjacent = self.adjacent[layer]
        sims = np.einsum("ij,ij->i", self.x[to], self.x[new])
        order = np.lexsort((-sims, to))
        to, new = to[order], new[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        more = min(int(counts.max()), cap)
        added = np.full((len(nodes), more), -1, np.int64)
        fits = place < more
        added[np.repeat(np.arange(len(nodes)), counts)[fits], place[fits]] = new[fits]
        for part in range(0, len(nodes), 512):
            own = nodes[part : part + 512]
            ids = np.concatenate([adjacent[own].astype(np.int64), added[part : part + 512]], 1)
            sims = np.einsum("ijk,ik->ij", self.x[ids], self.x[own])
            sims[ids < 0] = -np.inf
            chosen = self._diverse(ids, sims, cap)
            adjacent[own] = -1
            adjacent[own, : chosen.shape[1]] = chosen

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """For each row up to `most` of its ids: nearest first, those passed over at first that lie closer to one already
        chosen than to the row's node; they fill what stays free."""
        width = min(ids.shape[1], max(3 * most // 2, most))
        best = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        real = ~np.isneginf(sims)
        v = self.x[ids]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            closest = np.where(taken[:, :c], between[:, c, :c], -np.inf).max(1) if c else np.full(len(ids), -np.inf)
            ok = real[:, c] & (closest < sims[:, c]) & (count < most)
            taken[:, c] = ok
            count += ok
        rank = np.argsort(np.where(taken, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, rank, 1)
        out[~np.take_along_axis(real, rank, 1)] = -1
        return out.astype(np.int32)

    def beam(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes that a beam search from `entry` meets, for many queries in step: (ids, similarities), best
        first, with -1 and -inf where there are fewer."""
        adjacent, x, n = self.adjacent[layer], self.x, len(q)
        ids, sims = np.full((n, ef), -1, np.int64), np.full((n, ef), -np.inf, np.float32)
        done = np.ones((n, ef), bool)
        seen = np.zeros((n, len(adjacent)), bool)
        entry = entry[:, :ef]
        rows, cols = np.nonzero(entry >= 0)
        at = entry[rows, cols]
        seen[rows, at] = True
        ids[rows, cols], done[rows, cols] = at, False
        sims[rows, cols] = np.einsum("ij,ij->i", x[at], q[rows])
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_, min(width, ef) - 1, axis=1)[:, : min(width, ef)]
            real = ~np.isneginf(np.take_along_axis(open_, pick, 1))
            go = real.any(1)
            live, pick, real = live[go], pick[go], real[go]
            if not len(live):
                break
            done[live[:, None], pick] |= real
            at = np.where(real[:, :, None], adjacent[ids[live[:, None], pick]], -1).reshape(len(live), -1).astype(np.int64)
            at.sort(axis=1)
            fresh = at >= 0
            fresh[:, 1:] &= at[:, 1:] != at[:, :-1]
            fresh &= ~seen[live[:, None], at]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            new = at[r, c]
            seen[live[r], new] = True
            got = np.full(at.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ij,ij->i", x[new], q[live[r]])
            all_sims = np.concatenate([sims[live], got], 1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            all_ids = np.concatenate([ids[live], at], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        ids[np.isneginf(sims)] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.adjacent) - 1, 0, -1):
            entry, _ = self.beam(q, entry, 4, layer)
        return self.beam(q, entry, min(ef, len(self.x)), 0)

    def links(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with similarity of `least` or more. A beam that is full of them is widened once; queries that
        fill that too, or all if `ef` is no beam (0), are scanned."""
        row, node = [], []
        ask = np.arange(len(q))
        for width in (ef, 4 * ef):
            if not len(ask) or not 0 < width < len(self.x):
                break
            ids, sims = self.search(q[ask], width)
            full = sims[:, -1] >= least
            r, c = np.nonzero((sims >= least) & ~full[:, None])
            row.append(ask[r]), node.append(ids[r, c])
            ask = ask[full]
        for at in range(0, len(ask), 64):
            r, c = np.nonzero(q[ask[at : at + 64]] @ self.x.T >= least)
            row.append(ask[at + r]), node.append(c)
        return np.concatenate(row) if row else np.zeros(0, int), np.concatenate(node) if node else np.zeros(0, int)

    def audit(self, q: np.ndarray, least: float, ef: int, own: np.ndarray | None = None) -> tuple[int, float]:
        """(beam, recall): the narrowest beam from `ef` on that finds RECALL of the links which an exact scan gives for q,
        the nodes that `own` marks for each aside; 0, which is a scan, if none does."""
        true = q @ self.x.T >= least
        if own is not None:
            true &= ~own
        while 0 < ef <= WIDEST:
            found = np.zeros(true.shape, bool)
            found[self.links(q, least, ef)] = True
            recall = float((found & true).sum() / true.sum()) if true.any() else 1.0
            if recall >= RECALL:
                return ef, recall
            ef *= 2
        return 0, 1.0

    def probes(self, seed: int, threshold: float, most: int = PROBES) -> np.ndarray:
        """Vectors that have a cosine of `threshold` with nodes drawn at random: links that are known without a scan."""
        rng = np.random.default_rng(seed)
        x = self.x[rng.permutation(len(self.x))[:most]].astype(np.float64)
        turn = rng.standard_normal(x.shape)
        turn -= (turn * x).sum(1, keepdims=True) * x
        size = np.sqrt((turn * turn).sum(1, keepdims=True))
        turned = threshold * x + np.sqrt(1 - threshold**2) * turn / np.where(size > 1e-9, size, 1)
        return np.where(size > 1e-9, turned, x).astype(np.float32)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index reachable from each of n nodes over edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = np.minimum(root, root[root])
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _store(graph: Graph, keys: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, keys=keys, copies=copies, raw=raw, **{f"layer{i}": a for i, a in enumerate(graph.adjacent)})
    return out.getvalue()


def _load(blob: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(blob)) as got:
        layers = sorted(x for x in got.files if x.startswith("layer"))
        raw = got["raw"]
        return Graph(unit(raw).astype(np.float32), [got[x] for x in layers]), got["keys"], got["copies"], raw


def _ask(
    graph: Graph, keys: np.ndarray, copies: np.ndarray, raw: np.ndarray, q_keys: np.ndarray, q_raw: np.ndarray, threshold: float, ef: int
) -> pd.DataFrame:
    """Per query the copies it links to in this shard, and stars that span the links found here."""
    least = threshold - 1e-4  # similarities here are in single precision
    q = unit(q_raw).astype(np.float32)
    sample = np.random.default_rng(len(q)).permutation(len(q))[:AUDITED]
    ef, _ = graph.audit(q[sample], least, ef, q_keys[sample][:, None] == keys[None, :])
    linked = np.zeros(len(q), np.int64)
    ends_a, ends_b = [], []
    names = np.concatenate([q_keys, keys])
    for at in range(0, len(q), PART):
        r, c = graph.links(q[at : at + PART], least, ef)
        r = r + at
        other = q_keys[r] != keys[c]
        r, c = r[other], c[other]
        good = cosines(q_raw[r], raw[c]) >= threshold
        r, c = r[good], c[good]
        linked += np.bincount(r, weights=copies[c], minlength=len(q)).astype(np.int64)
        # a spanning star of this batch keeps what is carried on as small as the nodes
        root = local_roots(r, c + len(q), len(names))
        own = np.unique(np.concatenate([r, c + len(q)]))
        ends_a.append(own), ends_b.append(root[own])
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    root = local_roots(a, b, len(names))
    own = np.unique(a)
    return pd.DataFrame({"key": names[own], "linked": np.where(own < len(q), linked[np.minimum(own, len(q) - 1)], 0), "root": names[root[own]]})


def _nodes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(rows with `key`, stored distinct vectors by key, their number). A key is a hash; grouping goes by the vector too, and
    another hash is tried should two vectors have got one key."""
    for salt in range(20):
        keyed = rows.withColumn("key", F.when(usable(F.col("embedding")), F.xxhash64(F.lit(salt), F.size("embedding"), "embedding")))
        nodes = keyed.where("key is not null").groupBy("key", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        nodes = scratch.keep(nodes.withColumn("dim", F.size("embedding")), "nodes")
        n, keys = nodes.agg(F.count("*"), F.count_distinct("key")).first()
        if n == keys:
            return keyed, nodes, n
        scratch.drop(nodes)
    raise RuntimeError("no hash tells all vectors apart")


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    shards: int = SHARDS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing: n_links 0, a component of their
    own. Equal vectors, repeated rows included, link with each other. component_id is the least vec_id of the component,
    nulls aside. Vectors of unequal dimension don't link, and huge or tiny components neither overflow nor vanish. Links
    need a cosine of at least the threshold; ties play no part. Other columns are not looked at. An empty table gives no
    rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "near-vectors")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows, nodes, n = _nodes(rows, scratch)
    numbers = nodes.agg(F.sum("dim")).first()[0] or 0
    shards = max(shards, -(-(8 * numbers + 8 * (DEGREE + 2) * n) // SHARD_BYTES))
    blocks = max(1, -(-8 * numbers // QUERY_BYTES))
    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        dim, shard = int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0])
        raw = matrix(pdf["embedding"], dim)
        graph, order = Graph.build(unit(raw), shard)
        beam, recall = graph.audit(graph.probes(shard, threshold), threshold - 1e-4, BEAM)
        blob = _store(graph, pdf["key"].to_numpy()[order], pdf["copies"].to_numpy()[order], raw[order])
        return pd.DataFrame({"shard": [shard], "dim": [dim], "beam": [beam], "recall": [recall], "graph": [blob]})

    grown = sharded.groupBy("shard", "dim").applyInPandas(grow, "shard int, dim int, beam int, recall double, graph binary")
    graphs = scratch.keep(grown, "graphs")
    told = graphs.agg(F.count("*"), F.min("recall"), F.max("beam"), F.sum((F.col("beam") == 0).cast("int"))).first()
    log.info("%s graphs, recall of probes %s or more, beams of up to %s, %s scanned", *told)
    asked = nodes.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "dim", "block", "key", "embedding")
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "linked": [], "root": []}).astype("int64")
        b = b.sort_values("key")
        return _ask(*_load(a["graph"].iloc[0]), b["key"].to_numpy(), matrix(b["embedding"], int(b["dim"].iloc[0])), threshold, int(a["beam"].iloc[0]))

    by = ["shard", "dim", "block"]
    stars = scratch.keep(held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(meet, "key long, linked long, root long"), "stars")
    scratch.drop(graphs)
    linked = stars.groupBy("key").agg(F.sum("linked").alias("linked"))
    roots = connected_components(stars.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch)
    per = nodes.select("key", "copies", "least").join(linked, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    per = scratch.keep(per.withColumn("root", F.coalesce("root", "key")), "per-node")
    least = per.groupBy("root").agg(F.min("least").alias("component_id"))
    per = per.join(least, "root").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(per, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
