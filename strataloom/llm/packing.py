"""Best-fit packing of token sequences: bounded-space online best-fit over bins kept in a bitset keyed by free space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import CACHE_PIECES, WORD_FILE, crc, encoder, vocabulary

LENGTH = 2048
#: Bins that are open at once; the fullest closes when one more would be needed.
OPEN_BINS = 8192
#: Pieces that one packing task gets on average.
TASK_PIECES = 20_000


def pieces(docs: DataFrame, length: int, vocab: str, end_id: int, doc_id: str, text: str, cache: int = CACHE_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only where it is longer than `length`."""
    path = vocabulary(vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path, words=True, most=cache), np.array([end_id], np.uint32)
        for pdf in batches:
            ids_of, texts = pdf["doc_id"].array, [x if isinstance(x, str) else "" for x in pdf["text"]]
            for first, ids, bounds, _ in enc.encode(texts):
                rows = []
                for i in range(len(bounds) - 1):
                    own = np.concatenate([ids[bounds[i] : bounds[i + 1]], end])
                    rows += [(first + i, k, s, min(length, len(own) - s), crc(own[s : s + length])) for k, s in enumerate(range(0, len(own), length))]
                at, k, s, n, c = zip(*rows)
                yield pd.DataFrame({"doc_id": ids_of.take(list(at)), "piece": k, "start": s, "length": n, "ids_crc32": c})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(_nullable(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _nullable(run):
    """Ids pass through pandas as Int64, which keeps nulls and all 64 bits; repeated conversion to float would not."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(pdf.assign(doc_id=pdf["doc_id"].astype("Int64")) for pdf in batches)

    return wrapped


class Bins:
    """Open bins by free space: a bitset of the amounts that occur and, for each, the bins that have it."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.mask, self.next = length, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _put(self, bin_: int, free: int) -> None:
        self.by_free[free].append(bin_)
        self.mask |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return bin_

    def add(self, size: int) -> tuple[int, int]:
        """The bin and place of a piece: the fullest open bin that it fits, or a new one."""
        if fit := self.mask >> size:
            free = size + (fit & -fit).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_, self.next = self.length, self.next, self.next + 1
            if self.open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
        if free > size:
            self._put(bin_, free - size)
        return bin_, self.length - free


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    vocab: str = WORD_FILE,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
    task_pieces: int = TASK_PIECES,
    cache: int = CACHE_PIECES,
    doc_id: str = "doc_id",
    text: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: such a document is its end id alone. Repeated rows are packed each. A null doc_id stays
    null. An empty table gives no rows. Very long texts are cut to pieces; pieces of one length stand by id and place. Pieces
    are dealt by hash to tasks of about task_pieces rows and reach the bins in
    descending length, so equal input is packed alike; each task has bins of its own.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    cut = scratch.keep(pieces(docs, length, vocab, end_id, doc_id, text, cache), "pieces")
    n = cut.count()
    tasks = max(1, -(-n // task_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)).cast("int")
    dealt = cut.withColumn("task", deal).repartition(tasks, "task")
    dealt = dealt.sortWithinPartitions("task", F.desc("length"), "doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, task = None, None
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for i, (t, size) in enumerate(zip(pdf["task"].tolist(), pdf["length"].tolist())):
                if t != task:
                    bins, task = Bins(length, open_bins), t
                b, offset[i] = bins.add(size)
                sequence[i] = (t << 36) + b
            yield pdf.drop(columns="task").assign(sequence_id=sequence, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.mapInPandas(_nullable(run), schema)
