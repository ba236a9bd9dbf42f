"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of the relative frequencies of the 1- to ORDER-grams that end in it and of one even
share for every word and the unknown one. The weights depend on how often the context has been seen; expectation-maximisation
learns them on a tenth of the training documents, whose own counts are deleted from the frequencies while it runs.

Texts are cut once into batches of numbered words. A batch asks for each distinct n-gram of its own once, by hash, so that
even the most frequent one is a row per batch; what is asked is dealt by hash ranges, summed over all batches, and answered
batch by batch in the order of asking. No table of all n-grams is sent anywhere, and none is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hold
from .grams import cut, gram_hashes, slices

ORDER = 2
GAPS = b" \t\n\x0b\x0c\r"
#: Bytes of text in a batch, tokens whose n-grams one task sums, about, and one in how many training documents is left out.
BATCH_BYTES, PART_TOKENS, DELETED = 5_000_000, 1_000_000, 10
#: EM ends after so many rounds, or when a token's mean log-likelihood gains less.
ROUNDS, GAIN = 60, 1e-5
_BEGIN, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte of all."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of documents in batches: documents left out for the weights are batches of their own."""
    hold("interpolation", lambda: None)
    number = TaskContext.get().partitionId() << 33
    held: list[pa.RecordBatch] = []

    def cut_up(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal number
        table = table.combine_chunks()
        for deleted in (False, True):
            rows = table.filter(pa.array(table.column("deleted").to_numpy() == deleted))
            if not len(rows):
                continue
            texts = rows.column("text").combine_chunks()
            for begin, end in slices(texts, BATCH_BYTES):
                words = cut(texts.slice(begin, end - begin), GAPS)
                size = np.bincount(words.text, minlength=end - begin)
                ids = np.full(len(words.ids) + end - begin, len(words.vocabulary), np.uint32)
                ids[np.arange(len(words.ids)) + words.text] = words.ids
                learned = ~rows.column("held_out").to_numpy()[begin:end]
                lists = [pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), rows.column(c).combine_chunks().slice(begin, end - begin)) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([deleted]), *lists, pa.array([(size + 1).tolist()], pa.list_(pa.int32())), pa.array([pack(ids)]),
                        pa.array([pack(np.append(words.hashes(), _END))]), pa.array([int((size + 1)[learned].sum())]), pa.array([int(learned.sum())]),
                    ],
                    ["batch", "deleted", "doc_id", "held_out", "sizes", "ids", "words", "learned", "learned_docs"],
                )
                number += 1

    waiting = 0
    for batch in parts:
        held.append(batch)
        waiting += batch.nbytes
        if waiting >= BATCH_BYTES:
            yield from cut_up(pa.Table.from_batches(held))
            held, waiting = [], 0
    if held:
        yield from cut_up(pa.Table.from_batches(held))


def _asked(ids: bytes, words: bytes, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Hashes of the n-gram that ends at each token, for n from 1 to order; before a text stand marks of its beginning."""
    own = unpack(words, np.uint64)[unpack(ids, np.uint32)]
    at = np.arange(len(own)) + np.repeat((np.arange(len(sizes)) + 1) * (order - 1), sizes)
    padded = np.full(len(own) + len(sizes) * (order - 1), _BEGIN, np.uint64)
    padded[at] = own
    for n in range(1, order + 1):
        yield gram_hashes(padded, n)[at - n + 1]


def _requests(batches: Iterator[pa.RecordBatch], order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(n, part, batch, deleted, hashes, counts): a batch's distinct n-grams in order of hash, with the occurrences to learn."""
    hold("interpolation", lambda: None)
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    for rows in batches:
        for row in rows.to_pylist():
            sizes = np.array(row["sizes"])
            learned = np.repeat(~np.array(row["held_out"], bool), sizes)
            out = []
            for n, asked in enumerate(_asked(row["ids"], row["words"], sizes, order), 1):
                known, at = np.unique(asked, return_inverse=True)
                counts = np.bincount(at[learned], minlength=len(known)).astype(np.uint32)
                edges = [0, *np.searchsorted(known, cuts), len(known)]
                out += [(n, p, row["batch"], row["deleted"], pack(known[a:b]), pack(counts[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            columns = list(zip(*out))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n", "part", "batch", "deleted", "hashes", "counts"])


def _answer(table: pa.Table) -> pa.Table:
    """The sums of one range of hashes, told to each batch in the order in which it asked: all counts, and to batches left
    out those without any batch left out. One more row says how many n-grams there are."""
    deleted = np.array(table.column("deleted").to_pylist(), bool)
    hashes = [unpack(x, np.uint64) for x in table.column("hashes").to_pylist()]
    counts = [unpack(x, np.uint32) for x in table.column("counts").to_pylist()]
    size = [len(x) for x in hashes]
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    weights = np.concatenate(counts).astype(np.float64)
    total = np.bincount(at, weights, len(known)).astype(np.uint64)
    out = np.repeat(deleted, size)
    kept = total - np.bincount(at[out], weights[out], len(known)).astype(np.uint64)
    ends = np.cumsum(size)
    own = [at[b - s : b] for s, b in zip(size, ends)]
    n = len(table)
    return pa.table(
        [
            pa.concat_arrays([*table.column("n").chunks, pa.array([table.column("n")[0].as_py()], pa.int32())]),
            pa.concat_arrays([*table.column("part").chunks, pa.array([0], pa.int32())]),
            pa.concat_arrays([*table.column("batch").chunks, pa.array([None], pa.int64())]),
            pa.array([*[pack(total[i]) for i in own], None], pa.binary()),
            pa.array([*[pack(kept[i]) if d else None for i, d in zip(own, deleted)], None], pa.binary()),
            pa.array([None] * n + [int((total > 0).sum())], pa.int64()), pa.array([None] * n + [int((kept > 0).sum())], pa.int64()),
        ],
        ["n", "part", "batch", "total", "kept", "kinds", "kinds_kept"],
    )


class Frequencies:
    """Of each token of a batch: `counts` of its n-grams, and of their contexts `before`, for n from 1 to order."""

    def __init__(self, row: dict, answers: pa.Table, column: str, order: int, tokens: int, docs: int):
        self.sizes = np.array(row["sizes"])
        begins = np.cumsum(self.sizes) - self.sizes
        told = sorted(zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), answers.column(column).to_pylist()))
        self.counts, self.before = [], []
        for n, asked in enumerate(_asked(row["ids"], row["words"], self.sizes, order), 1):
            own = np.concatenate([unpack(x, np.uint64) for k, _, x in told if k == n])
            self.counts.append(own[np.unique(asked, return_inverse=True)[1]].astype(np.float64))
            if n == 1:
                self.before.append(np.full(len(asked), float(tokens)))
            else:
                last = np.roll(self.counts[n - 2], 1)
                last[begins] = docs  # after the beginning of a text
                self.before.append(last)

    def terms(self, kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, relative frequencies): a column for the even share and one for each n. A bucket is 64 times the number
        of contexts seen, plus the binary logarithm of the longest one's count where it has a word."""
        parts = [np.full(len(self.counts[0]), 1 / (kinds + 1))]
        seen, longest = np.zeros(len(parts[0]), np.int64), np.ones(len(parts[0]))
        for n, (c, h) in enumerate(zip(self.counts, self.before), 1):
            parts.append(np.where(h > 0, c / np.maximum(h, 1), 0.0))
            seen[h > 0] = n
            if n > 1:
                longest = np.where(h > 0, h, longest)
        return seen * 64 + np.log2(longest).astype(np.int64), np.stack(parts, 1)


def _plain_weights(bucket: int, order: int) -> np.ndarray:
    """Even weights for what a bucket has seen."""
    return np.where(np.arange(order + 1) <= bucket // 64, 1 / (bucket // 64 + 1), 0.0)


def _spread(weights: dict[int, np.ndarray], buckets: np.ndarray, order: int) -> np.ndarray:
    """A row of weights for each bucket; one that wasn't met while learning takes those of the nearest like it."""
    kinds, at = np.unique(buckets, return_inverse=True)

    def of(b: int) -> np.ndarray:
        like = [k for k in weights if k // 64 == b // 64]
        return weights[min(like, key=lambda k: (abs(k - b), k))] if like else _plain_weights(b, order)

    return np.stack([of(int(b)) for b in kinds])[at] if len(kinds) else np.zeros((0, order + 1))


def _learned_weights(events: DataFrame, order: int) -> dict[int, np.ndarray]:
    """Weights by bucket. Each round is a pass over all events, of which sums per task and bucket come back: at most 64 a
    context length. A pseudo-event with even weights keeps each weight above zero."""
    weights: dict[int, np.ndarray] = {}
    names = [f"w{i}" for i in range(order + 1)]
    mark = -np.inf
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            hold("interpolation", lambda: None)
            for pdf in batches:
                for b, t in zip(pdf["bucket"], pdf["terms"]):
                    bucket = unpack(b, np.uint16).astype(np.int64)
                    shares = _spread(weights, bucket, order) * unpack(t, np.float32).reshape(-1, order + 1)
                    p = shares.sum(1)
                    kinds, at = np.unique(bucket, return_inverse=True)
                    sums = [np.bincount(at, shares[:, i] / p, len(kinds)) for i in range(order + 1)]
                    yield pd.DataFrame({"bucket": kinds, **dict(zip(names, sums)), "n": np.bincount(at), "fit": np.bincount(at, np.log(p))})

        summed = events.mapInPandas(expect, f"bucket long, {', '.join(f'{w} double' for w in names)}, n long, fit double")
        rows = summed.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in (*names, "n", "fit")]).collect()
        if not rows:
            break
        even = {r["bucket"]: _plain_weights(r["bucket"], order) for r in rows}
        weights = {r["bucket"]: (np.array([r[w] for w in names]) + even[r["bucket"]]) / (r["n"] + 1) for r in rows}
        fit = sum(r["fit"] for r in rows) / sum(r["n"] for r in rows)
        if fit - mark < GAIN:
            break
        mark = fit
    return weights


def score_texts(
    docs: DataFrame, held_out: Column, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end of the text. Learns from all rows that are not held_out (null counts as not).
    base_score is the log10 probability under word counts with one added to each and to one unknown word; score that of the
    model. Null texts are empty and have their end only; very long texts are a batch alone and are read whole. Rows that
    repeat count each time, so ties have equal scores. Without rows to learn from both scores are 0. Other columns are not
    looked at, whatever their names; n-grams are told apart by 64 bits of hash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "interpolation")
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.col(text).cast("string")
    held = F.coalesce(held_out, F.lit(False))
    left_out = ~held & (F.pmod(F.xxhash64(F.col(doc_id), whole), F.lit(DELETED)) == 0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), held.alias("held_out"), left_out.alias("deleted"))
    schema = f"batch long, deleted boolean, doc_id array<{kind}>, held_out array<boolean>, sizes array<int>, ids binary, words binary, learned long, learned_docs long"
    tokens = scratch.keep(rows.mapInArrow(_batches, schema), "tokens")
    kept = F.when(~F.col("deleted"), 1).otherwise(0)
    n, texts, n_kept, texts_kept, size = tokens.agg(
        F.sum("learned"), F.sum("learned_docs"), F.sum(F.col("learned") * kept), F.sum(F.col("learned_docs") * kept), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))
    ).first()
    if not size:
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TOKENS))
    asked = tokens.mapInArrow(lambda b: _requests(b, order, parts), "n int, part int, batch long, deleted boolean, hashes binary, counts binary")
    answers = asked.groupBy("n", "part").applyInArrow(_answer, "n int, part int, batch long, total binary, kept binary, kinds long, kinds_kept long")
    answers = scratch.keep(answers, "answers")
    kinds, kinds_kept = answers.where("n = 1 and batch is null").agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("kinds_kept"), F.lit(0))).first()
    answers = answers.where("batch is not null")

    def events(own: pa.Table, told: pa.Table) -> pa.Table:
        bucket, terms = Frequencies(own.to_pylist()[0], told, "kept", order, n_kept, texts_kept).terms(kinds_kept)
        return pa.table([pa.array([pack(bucket.astype(np.uint16))], pa.binary()), pa.array([pack(terms.astype(np.float32).reshape(-1))], pa.binary())], ["bucket", "terms"])

    left = tokens.where("deleted").groupBy("batch").cogroup(answers.where("kept is not null").groupBy("batch"))
    learning = scratch.keep(left.applyInArrow(events, "bucket binary, terms binary"), "events")
    sent = spark.sparkContext.broadcast(_learned_weights(learning, order))
    scratch.drop(learning)

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        f = Frequencies(row, told, "total", order, n, texts)
        bucket, terms = f.terms(kinds)
        p = (_spread(sent.value, bucket, order) * terms).sum(1)
        begins = np.cumsum(f.sizes) - f.sizes
        base = np.log10((f.counts[0] + 1) / (n + kinds + 1))
        m = len(f.sizes)
        return pa.table(
            [
                own.column("doc_id").combine_chunks().flatten(), pa.array(row["held_out"], pa.bool_()), pa.array(f.sizes.astype(np.int64)),
                pa.array(np.add.reduceat((f.counts[0] > 0).astype(np.int64), begins)), pa.array([n] * m, pa.int64()), pa.array(np.add.reduceat(base, begins)),
                pa.array(np.add.reduceat(np.log10(p), begins)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    both = tokens.groupBy("batch").cogroup(answers.groupBy("batch"))
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.applyInArrow(score, schema)
