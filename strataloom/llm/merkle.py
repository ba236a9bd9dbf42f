"""A Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups' roots; a proof for every row.

Rows are numbered within their group by ranges. Blocks of 2 ** BLOCK_LEVELS leaves become one node each, in tasks; where
that leaves more than TOP_NODES nodes, blocks of nodes are reduced again. The driver builds the small rest and broadcasts the
path from each of its nodes to the root (TOP_NODES paths at most). Tasks then go through their blocks once more, put the
path inside the block before that of the block, and fold each row's claimed leaf up to a root of its own.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, small

#: Levels that a task reduces at once, and nodes that may come to the driver.
BLOCK_LEVELS, TOP_NODES = 12, 8192
_NODE = "gn boolean, g string, n long, pos long, hash string"


def digest_of(columns: list[Column]) -> Column:
    """Hex sha256 of columns: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give: entries are `l` or `r` and the sibling to that side, or `-` for none."""
    side, other = lambda s: F.substr(s, F.lit(1), F.lit(1)), lambda s: F.substr(s, F.lit(2))
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.when(side(s) == "l", F.concat(other(s), h)).otherwise(F.concat(h, other(s))), 256))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(hashes: list[str], n: int, most: int | None = None) -> list[list[str]]:
    """The nodes of each level over consecutive ones of a tree that has n at their level: up to the root, or `most` levels."""
    out = [hashes]
    while n > 1 and (most is None or len(out) <= most):
        last = out[-1]
        out.append([_hash("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
        n = (n + 1) // 2
    return out


def _way(levels: list[list[str]], i: int) -> list[str]:
    """Siblings from node i of the lowest level to the highest."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append("-" if j >= len(level) else ("l" if j < i else "r") + level[j])
        i >>= 1
    return out


def _after(n: int, levels: int) -> int:
    for _ in range(levels):
        n = (n + 1) // 2
    return n


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """A node for each block of consecutive nodes (gn, g, n, pos, hash)."""

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        top = _levels(table.column("hash").to_pylist(), n, levels)[-1]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.string()), pa.array([_after(n, levels)]), pa.array([key[2].as_py()]), pa.array(top)], ["gn", "g", "n", "pos", "hash"])

    dealt = nodes.select("gn", "g", "n", "pos", "hash", F.shiftright("pos", levels).alias("block"))
    return dealt.groupBy("gn", "g", "block").applyInArrow(reduce, _NODE)


def _placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows with `pos`, their place in their group (gn, g) by `order`, and `n`, the group's size.

    Rows equal in all of gn, g and order are numbered first, so that ranges can part them. Only a row per range and group is
    summed over others."""
    key = [F.desc("gn"), F.asc("g"), *[F.asc_nulls_first(c) for c in order]]
    summed = rows.groupBy("gn", "g", *order).agg(F.count("*").alias("copies"))
    each = summed.select("gn", "g", *order, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = each.repartitionByRange(parts, *key, "copy").sortWithinPartitions(*key, "copy").drop("copy").withColumn("id", F.monotonically_increasing_id())
    dealt = scratch.keep(dealt.withColumn("part", F.shiftright("id", 33)), "ranges")
    runs = dealt.groupBy("gn", "g", "part").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    own = W.partitionBy("gn", "g")
    before = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("gn", "g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    runs = small(scratch.keep(runs, "runs"))
    return dealt.join(runs, ["gn", "g", "part"]).withColumn("pos", F.col("id") + F.col("shift")).drop("id", "part", "shift")


def _ways(nodes: DataFrame, levels: int, top: int, scratch: Scratch) -> DataFrame | dict:
    """The way from each block of nodes to its group's root, (gn, g, pos) -> (hash of the root, siblings): a dictionary if
    the blocks are `top` or fewer, else a table."""
    up = scratch.keep(_reduced(nodes, levels), "nodes")
    count, widest = up.agg(F.count("*"), F.max("n")).first()
    if count <= top:
        groups = defaultdict(dict)
        for r in up.collect():
            groups[r["gn"], r["g"]][r["pos"]] = r["hash"]
        out = {}
        for group, own in groups.items():
            rising = _levels([own[i] for i in range(len(own))], len(own))
            out |= {(*group, i): (rising[-1][0], _way(rising, i)) for i in own}
        return out
    if widest == 1:
        return up.select("gn", "g", "pos", F.col("hash").alias("root"), F.array().cast("array<string>").alias("way"))
    return scratch.keep(_finished(up, _ways(up, levels, top, scratch), levels), "ways")


def _through(nodes: DataFrame, ways: DataFrame | dict, levels: int, task, schema: str) -> DataFrame:
    """task(sorted block, its levels, root, way of the block) for each block of nodes."""

    def run(table: pa.Table, root: str, way: list[str]) -> pa.Table:
        table = table.sort_by("pos")
        return task(table, _levels(table.column("hash").to_pylist(), table.column("n")[0].as_py(), levels), root, way)

    dealt = nodes.withColumn("block", F.shiftright("pos", levels))
    if isinstance(ways, dict):
        sent = nodes.sparkSession.sparkContext.broadcast(ways)

        def known(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return run(table, *sent.value[tuple(k.as_py() for k in key)])

        return dealt.groupBy("gn", "g", "block").applyInArrow(known, schema)

    def both(table: pa.Table, own: pa.Table) -> pa.Table:
        return run(table, own.column("root")[0].as_py(), own.column("way")[0].as_py())

    own = ways.withColumnRenamed("pos", "block")
    return dealt.groupBy("gn", "g", "block").cogroup(own.groupBy("gn", "g", "block")).applyInArrow(both, schema)


def _finished(nodes: DataFrame, ways: DataFrame | dict, levels: int) -> DataFrame:
    """(gn, g, pos, root, way) for every node."""

    def task(table: pa.Table, rising: list[list[str]], root: str, way: list[str]) -> pa.Table:
        mine = [_way(rising, i) + way for i in range(len(table))]
        return pa.table([table.column("gn"), table.column("g"), table.column("pos"), pa.array([root] * len(table)), pa.array(mine, pa.list_(pa.string()))], ["gn", "g", "pos", "root", "way"])

    return _through(nodes, ways, levels, task, "gn boolean, g string, pos long, root string, way array<string>")


def manifest(
    docs: DataFrame, fields: list[str], group: str, order: str, claimed: dict[str, Column] | None = None, proofs: bool = True,
    levels: int = BLOCK_LEVELS, top: int = TOP_NODES, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of docs: `order`, leaf, subroot (its group's root), root, proof_sha256 (of its siblings from the leaf
    up), folded_root (from the leaf of the row with the `claimed` columns in place of its own, and the proof), verified; and
    the proof itself, if `proofs`, as fold() takes it.

    Groups are text; they are ordered by UTF-8 bytes, null first. In a group rows ascend by `order`, nulls first, then by
    leaf, so rows that repeat have the same leaf and places of their own. A lone node at the end of a level is hashed alone.
    Nulls, empty and very long values count whole; other columns are not looked at. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    said = claimed or {}
    key = F.col(group).cast("string")
    rows = docs.select(
        key.isNull().alias("gn"), F.coalesce(key, F.lit("")).alias("g"), F.col(order).alias("row"), digest_of([F.col(c) for c in fields]).alias("hash"),
        digest_of([said.get(c, F.col(c)) for c in fields]).alias("claim"),
    )
    leaves = scratch.keep(_placed(rows, ["row", "hash", "claim"], scratch), "leaves")
    ways = _ways(leaves, levels, top, scratch)
    if isinstance(ways, dict):  # few blocks, so few groups: the driver ends the upper tree as well
        groups = sorted({k[:2]: root for k, (root, _) in ways.items()}.items(), key=lambda x: (not x[0][0], x[0][1].encode()))
        rising = _levels([root for _, root in groups], len(groups))
        above = {k: _way(rising, i) for i, (k, _) in enumerate(groups)}
        whole = {k: (f"{root} {rising[-1][0]}", way + above[k[:2]]) for k, (root, way) in ways.items()}
    else:
        roots = ways.where("pos = 0").select(F.lit(False).alias("gn"), F.lit("").alias("g"), (~F.col("gn")).alias("a"), F.col("g").alias("b"), F.col("root").alias("hash"))
        upper = scratch.keep(_placed(roots, ["a", "b", "hash"], scratch), "groups")
        upper_ways = _finished(upper, _ways(upper, levels, top, scratch), levels).withColumnsRenamed({"root": "top", "way": "rest"})
        upper_ways = upper.join(upper_ways, "pos").select((~F.col("a")).alias("gn"), F.col("b").alias("g"), "top", "rest")
        whole = ways.join(scratch.keep(upper_ways, "upper"), ["gn", "g"])
        whole = whole.select("gn", "g", "pos", F.concat_ws(" ", "root", "top").alias("root"), F.concat("way", "rest").alias("way"))

    def task(table: pa.Table, rising: list[list[str]], root: str, way: list[str]) -> pa.Table:
        subroot, above = root.split(" ")
        rest = "".join(s[1:] for s in way)
        digests, folded, whole = [], [], []
        for i, h in enumerate(table.column("claim").to_pylist()):
            near = _way(rising, i)
            digests.append(_hash("".join(s[1:] for s in near) + rest))
            for s in near + way:
                h = _hash(s[1:] + h if s[0] == "l" else h + s[1:])
            folded.append(h)
            if proofs:
                whole.append(near + way)
        n = len(table)
        columns = {"row": table.column("row"), "leaf": table.column("hash"), "subroot": pa.array([subroot] * n), "root": pa.array([above] * n), "proof_sha256": pa.array(digests), "folded_root": pa.array(folded)}
        if proofs:
            columns["proof"] = pa.array(whole, pa.list_(pa.string()))
        return pa.table(columns)

    kind = docs.schema[order].dataType.simpleString()
    schema = f"row {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", proof array<string>" * proofs
    out = _through(leaves, whole, levels, task, schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("row", order)
