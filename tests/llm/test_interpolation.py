"""Deleted interpolation against a plain model in dictionaries."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import interpolation as ip
from strataloom.llm.common import Scratch
from tests.llm.test_operators import DOCS, ODD

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _tokens(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def _counts(texts, order):
    """Counts of n-grams and of contexts; `before` are marks of a text's beginning."""
    grams, contexts = Counter(), Counter()
    for t in texts:
        padded = ["<s>"] * (order - 1) + t
        for i in range(order - 1, len(padded)):
            for n in range(1, order + 1):
                grams[tuple(padded[i - n + 1 : i + 1])] += 1
                contexts[tuple(padded[i - n + 1 : i])] += 1
    return grams, contexts


def _events(texts, model, order):
    grams, contexts = model
    kinds = sum(len(g) == 1 for g in grams)
    for t in texts:
        padded = ["<s>"] * (order - 1) + t
        for i in range(order - 1, len(padded)):
            terms, seen, longest = [1 / (kinds + 1)], 0, 1
            for n in range(1, order + 1):
                h = contexts[tuple(padded[i - n + 1 : i])]
                terms.append(grams[tuple(padded[i - n + 1 : i + 1])] / h if h else 0.0)
                if h:
                    seen, longest = n, h if n > 1 else 1
            yield seen * 64 + int(math.log2(longest)), terms


def _plain(rows, left_out, order):
    said = [(i, _tokens(t), held) for i, t, held in rows]
    learned = [x for x in said if not x[2]]
    weights, mark = {}, -math.inf
    kept = _counts([t for x, (_, t, _) in zip(rows, said) if not x[2] and (x[0], x[1]) not in left_out], order)
    events = list(_events([t for x, (_, t, _) in zip(rows, said) if not x[2] and (x[0], x[1]) in left_out], kept, order))
    even = lambda b: [1 / (b // 64 + 1) if n <= b // 64 else 0.0 for n in range(order + 1)]
    for _ in range(ip.ROUNDS if events else 0):
        sums, n, fit = defaultdict(lambda: np.zeros(order + 1)), Counter(), 0.0
        for b, terms in events:
            shares = np.array(weights.get(b, even(b))) * np.array(terms)
            sums[b] += shares / shares.sum()
            n[b] += 1
            fit += math.log(shares.sum())
        weights = {b: (sums[b] + even(b)) / (n[b] + 1) for b in sums}
        if fit / len(events) - mark < ip.GAIN:
            break
        mark = fit / len(events)
    model = _counts([t for _, t, _ in learned], order)
    total, kinds = sum(len(t) for _, t, _ in learned), sum(len(g) == 1 for g in model[0])
    out = []
    for i, t, held in said:
        score = 0.0
        for b, terms in _events([t], model, order):
            like = [k for k in weights if k // 64 == b // 64]
            own = weights[min(like, key=lambda k: (abs(k - b), k))] if like else even(b)
            score += math.log10(sum(w * x for w, x in zip(own, terms)))
        c = [model[0][w,] for w in t]
        out.append((i, held, len(t), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + kinds + 1)) for x in c), score))
    return out


def _same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-5, abs=1e-5) for r in want]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, monkeypatch, order):
    rows = [(i, " ".join("abcde"[(i * k + k * k) % (2 + i % 4)] + "AB"[k % 2] for k in range(1 + i % 23)) + ("\n" if i % 2 else ""), i % 6 == 1) for i in range(150)]
    rows += [(3, "same again", False)] * 3 + [(900, None, False), (901, "", True), (902, "never seen", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    left = {(r[0], r[1]) for r in docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ip.DELETED)) == 0).collect()}
    _same(ip.score_texts(docs, F.col("held"), order=order).select(COLUMNS).collect(), _plain(rows, left, order))


def test_odd_tables(spark):
    odd = spark.createDataFrame(ODD, DOCS).withColumnsRenamed({"n_chars": "batch", "fp": "ids", "size": "deleted"})
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = ip.score_texts(odd, held)
    assert got.columns == COLUMNS and got.count() == len(ODD)
    flags = {r["doc_id"]: r["held_out"] for r in got.collect()}
    rows = [(r[0], r[1], flags[r[0]]) for r in ODD]
    left = {(r[0], r[1]) for r in odd.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ip.DELETED)) == 0).collect()}
    _same(got.collect(), _plain(rows, left, ip.ORDER))
    assert ip.score_texts(spark.createDataFrame([], DOCS), held).count() == 0
    nothing = ip.score_texts(odd, F.lit(True)).agg(F.max("train_tokens"), F.sum("n_known"), F.min("score"), F.min("base_score")).first()
    assert tuple(nothing) == (0, 0, 0.0, 0.0)
    named = spark.createDataFrame([("x", "a b", False), ("y", "b", True)], "doc_id string, text string, held boolean")
    assert {r["doc_id"] for r in ip.score_texts(named, F.col("held")).collect()} == {"x", "y"}


def test_packed_numbers_and_bounds(spark):
    a = np.random.default_rng(1).integers(0, 1 << 63, 999, np.uint64)
    assert (ip.unpack(ip.pack(a), np.uint64) == a).all() and len(ip.unpack(ip.pack(a[:0]), np.uint32)) == 0
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    asked = []
    keep = Scratch.keep

    def spy(self, df, name):
        out = keep(self, df, name)
        asked.append((name, out))
        return out

    Scratch.keep, before = spy, Scratch.keep
    try:
        ip.score_texts(docs, F.col("doc_id") % 7 == 2).count()
    finally:
        Scratch.keep = before
    tables = dict(asked)
    assert tables["answers"].where("batch is not null").count() <= 2 * 5 * tables["tokens"].count()  # five distinct pairs, four words and an end
