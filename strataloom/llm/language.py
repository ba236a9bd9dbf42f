"""Language identification by prediction by partial matching over bytes.

Per language a context tree of up to ORDER preceding bytes is counted on a bounded sample of documents and frozen. A byte
that a context has seen costs its share there (escape method C: c / (T + q)); another costs the escape q / (T + q) and then
its share under the next shorter context, among the bytes that the longer one has not seen; the shortest context falls back
on all 256 bytes evenly. So the shares of each context sum to one and a text's code length under a language is exact.

Since nothing adapts, a tree is stored as sorted arrays: per depth the contexts met with the bits that escaping from them
costs (the exclusion included), and the bytes met in them with their bits. A byte is looked up in its longest context and,
as often as it has to escape, in the next shorter one. Memory grows with the contexts learned; none is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, ship

#: Bytes of context; up to 6, as a context and its byte share a signed 64-bit key.
ORDER = 4
#: Labelled documents, and bytes of their texts, that each language is learned from, about; the smaller bound holds. They
#: are dealt by hash, so reruns agree, and are taken whole; one document is always taken.
DOCS_PER_LANG, BYTES_PER_LANG = 400, 2_000_000
#: Bytes scored at a time.
SLICE_BYTES = 1 << 19
PAD = b" "  # blanks stand before each text
UNKNOWN = "und"


@dataclass
class Counts:
    """What the trees are made of: per language the contexts of full depth, each with its next byte as the low byte of a
    sorted key, and how often they occurred."""

    order: int
    langs: list[str]
    keys: list[np.ndarray]
    counts: list[np.ndarray]


def _grams(texts: list[bytes], order: int) -> np.ndarray:
    """The key of every byte of the texts, in turn: the bytes before it, blanks before a text's start, then itself."""
    data = np.frombuffer(b"".join(PAD * order + t for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    n = max(len(data) - order, 0)
    key = np.zeros(n, np.uint64)
    for i in range(order + 1):
        key = (key << np.uint64(8)) | data[i : i + n]
    # windows that begin within the last bytes of one text would end in the next
    inside = np.repeat(np.tile([True, False], len(texts)), np.stack([size, np.full(len(texts), order)], 1).ravel())
    return key[inside[:n]]


def count_grams(batches: Iterator[pd.DataFrame], order: int = ORDER) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            key, n = np.unique(_grams([t.encode("utf-8", "replace") for t in texts], order), return_counts=True)
            if len(key):
                yield pd.DataFrame({"lang": lang, "gram": key.astype(np.int64), "n": n})


def learn(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    doc_id: str = "doc_id",
    docs_per_lang: int = DOCS_PER_LANG,
    bytes_per_lang: int = BYTES_PER_LANG,
    order: int = ORDER,
) -> Counts:
    """Counts of the labelled rows of docs (text and language not null). What reaches the driver grows with the texts that
    are drawn, which are bounded for each language whatever the table's size."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).alias("k"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("text") != ""))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("k", "lang", "text"), F.lit(1 << 30)) / float(1 << 30))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min("draw").alias("least")).collect()
    if not found:
        return Counts(order, [], [], [])
    rate = {r["lang"]: max(r["least"], min(1.0, docs_per_lang / r["n"], bytes_per_lang / r["size"])) for r in found}
    rates = F.create_map(*[F.lit(x) for kv in sorted(rate.items()) for x in kv])
    taken = rows.where(F.col("draw") <= F.element_at(rates, F.col("lang"))).select("lang", "text")
    grams = taken.mapInPandas(lambda b: count_grams(b, order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = grams.toPandas()
    out = Counts(order, [], [], [])
    for name, own in got.groupby("lang"):
        own = own.sort_values("gram")
        out.langs.append(name)
        out.keys.append(own["gram"].to_numpy(np.uint64))
        out.counts.append(own["n"].to_numpy(np.int64))
    return out


class Tree:
    """One language's frozen contexts. levels[o - 1] holds those of o bytes: sorted keys of (context, byte), the bits of
    each, sorted contexts, and the bits of escaping from each."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray):
        own = np.bincount((keys & np.uint64(255)).astype(np.int64), weights=counts, minlength=256)
        total, kinds = own.sum(), int((own > 0).sum())
        share = own / total if kinds == 256 else np.where(own > 0, own, kinds / (256 - kinds)) / (total + kinds)
        self.bits = -np.log2(share)
        self.levels = []
        lower_keys, lower = np.arange(256, dtype=np.uint64), share
        for depth in range(1, order + 1):
            key, n = self._cut(keys, counts, depth)
            context, first, kinds = np.unique(key >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first)
            each = np.repeat(np.arange(len(context)), kinds)
            below = lower[np.searchsorted(lower_keys, key & np.uint64((1 << 8 * depth) - 1))]
            room = np.maximum(1 - np.add.reduceat(below, first), 1e-12)
            full = kinds == 256
            share = n / (total + np.where(full, 0, kinds))[each]
            escape = np.where(full, 0.0, -np.log2(kinds / (total + kinds) / room))
            self.levels.append((key, -np.log2(share), context, escape))
            lower_keys, lower = key, share

    @staticmethod
    def _cut(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(keys & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        return key, np.bincount(at, weights=counts)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the low byte of each key after the bytes before it."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for depth in range(len(self.levels), 0, -1):
            known, bits, contexts, escape = self.levels[depth - 1]
            key = keys[left] & np.uint64((1 << 8 * (depth + 1)) - 1)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            met = known[at] == key
            out[left[met]] += bits[at[met]]
            left, context = left[~met], key[~met] >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[left] += np.where(contexts[at] == context, escape[at], 0.0)
        out[left] += self.bits[(keys[left] & np.uint64(255)).astype(np.int64)]
        return out


class Model:
    """The trees of all languages."""

    def __init__(self, counts: Counts):
        self.langs, self.order = counts.langs, counts.order
        self.trees = [Tree(counts.order, k, c) for k, c in zip(counts.keys, counts.counts)]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        group: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            # a long text goes in parts; each begins with the bytes of context before it
            for at in range(0, len(t), SLICE_BYTES):
                part = PAD * max(self.order - at, 0) + t[max(at - self.order, 0) : at + SLICE_BYTES]
                group.append((i, part))
                size += len(part)
                if size >= SLICE_BYTES:
                    self._add(group, out)
                    group, size = [], 0
        if group:
            self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, bytes]], out: np.ndarray) -> None:
        order = self.order
        data = np.frombuffer(b"".join(p for _, p in group), np.uint8)
        n = len(data) - order
        key = np.zeros(n, np.uint64)
        for i in range(order + 1):
            key = (key << np.uint64(8)) | data[i : i + n]
        coded = pa.array(key).dictionary_encode()
        kinds, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        sort = np.argsort(kinds)
        place = np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        kinds, at = kinds[sort], place[at]
        lens = np.array([len(p) for _, p in group])
        first = np.cumsum(lens) - lens
        # a part's own keys are those from its start to `order` before its end; those across a seam count for nothing
        bounds = np.stack([first, first + lens - order], 1).ravel()
        rows = np.array([i for i, _ in group])
        cost = np.zeros(n + 1)
        for j, tree in enumerate(self.trees):
            cost[:n] = tree.cost(kinds)[at]
            np.add.at(out[:, j], rows, np.add.reduceat(cost, bounds)[::2])


_MODELS: dict[str, Model] = {}


def _model(key: str, grams) -> Model:
    """This worker's trees for broadcast counts."""
    hold("language", _MODELS.clear)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(grams.value)
    return _MODELS[key]


def predict(texts: pd.Series, model: Model) -> pd.DataFrame:
    """(lang, score) of each text: the language with the shortest code (the first by name on a tie) and its posterior."""
    whole = [t if isinstance(t, str) else "" for t in texts]
    lettered = np.array([any(map(str.isalpha, t)) for t in whole], bool)
    names = np.full(len(whole), UNKNOWN, object)
    score = np.zeros(len(whole))
    at = np.flatnonzero(lettered)
    if len(at) and model.langs:
        bits = model.code_lengths([whole[i].encode("utf-8", "replace") for i in at])
        best = bits.argmin(1)
        names[at] = np.array(model.langs, object)[best]
        score[at] = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
    return pd.DataFrame({"lang": names, "score": score})


def predictor(spark, grams: Counts):
    """A column function text -> struct(lang, score). The model travels as its counts."""
    sent, key = spark.sparkContext.broadcast(grams), uuid.uuid4().hex

    @F.pandas_udf("lang string, score double")
    def language(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(key, sent)
        for texts in parts:
            yield predict(texts, model)

    return language


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """docs with two more columns lang_pred and lang_score, learned from the labelled rows of `training`.

    Null texts and texts without a letter get `und` and 0, and so does every text if nothing is learned. Equal texts get
    equal answers; of languages with equal code lengths the first by name is told. Very long texts are read whole, in
    slices. The columns of docs stay as they are, but for columns with those two names, which are replaced.
    """
    tell = predictor(docs.sparkSession, learn(training, lang, text, doc_id))
    told = docs.drop("lang_pred", "lang_score").withColumn("lang_pred", tell(F.col(text).cast("string")))
    return told.withColumn("lang_score", F.col("lang_pred.score")).withColumn("lang_pred", F.col("lang_pred.lang"))


def confident(lang: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a document's language counts as known."""
    return (lang != UNKNOWN) & (score >= least)
