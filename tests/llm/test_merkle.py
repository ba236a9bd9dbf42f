"""The manifest against a tree built in one place, on blocks and tops of all sizes."""

from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from strataloom.llm import merkle
from tests.llm.test_operators import DOCS, ODD

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes):
    """(root, the siblings of each node with their side)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            pair = [j for j in (k - k % 2, k - k % 2 + 1) if j < len(nodes) and j != k]
            ways[i] += [(j < k, nodes[j]) for j in pair] or [(None, "")]
            at[i] = k // 2
        nodes = [_h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def _plain(rows, bad):
    groups = defaultdict(list)
    for r in rows:
        own = [r[c] for c in FIELDS]
        said = [r["n_chars"] + 1 if c == "n_chars" and bad(r) and r["n_chars"] is not None else r[c] for c in FIELDS]
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"], _leaf(own), _leaf(said)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, *x[2:]))]) for g in names}
    root, above = _tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, up in zip(names, above):
        for (_, i, leaf, h), way in zip(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, *x[2:])), trees[g][1]):
            for left, s in way + up:
                h = _h(s, h) if left else _h(h, s)
            out.append((i, leaf, trees[g][0], root, _h(*[s for _, s in way + up]), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, top", [(12, 8192), (2, 8192), (2, 3), (1, 2), (3, 1)])
def test_against_one_tree(spark, levels, top):
    """Few blocks, many, several rounds of blocks, and more groups than the driver may hold."""
    rows = [(i if i % 11 else None, f"text {i % 40}", ["en", "fr", None, "é", "", "zz", "a"][(i * i) % 7], "s", i % 5 or None) for i in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    claim = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.manifest(docs, FIELDS, "lang", "doc_id", claim, levels=levels, top=top)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = _plain([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows], lambda r: (r["doc_id"] or 1) % 3 == 0)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == want
    honest = merkle.manifest(docs, FIELDS, "lang", "doc_id", levels=levels, top=top)
    again = honest.select("verified", merkle.fold(F.col("leaf"), F.col("proof")).alias("h"), "root").where("h <> root or not verified")
    assert again.count() == 0


def test_odd_tables(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumnsRenamed({"score": "root", "fp": "hash", "size": "pos"})
    got = merkle.manifest(odd, FIELDS, "lang", "doc_id", levels=1, top=2)
    want = _plain([dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in ODD], lambda r: False)
    assert sorted(map(tuple, got.drop("proof").collect()), key=repr) == want and len(want) == len(ODD)
    assert merkle.manifest(spark.createDataFrame([], DOCS), FIELDS, "lang", "doc_id").count() == 0
    one = merkle.manifest(odd.where("doc_id = 9"), FIELDS, "lang", "doc_id").first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == [] and one["proof_sha256"] == _h("")


def test_equal_rows_part(spark):
    """20000 equal rows lie in many ranges and blocks."""
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    got = merkle.manifest(docs, FIELDS, "lang", "doc_id", levels=6, proofs=False).agg(F.count("*"), F.count_distinct("proof_sha256"), F.bool_and("verified")).first()
    nodes = [_leaf([None, "s", "en", 1, "t"])] * 20_000
    assert tuple(got) == (20_000, len({_h(*[s for _, s in way]) for way in _tree(nodes)[1]}), True)
