"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' character spans are joined to the spans of its sections; a token that
crosses a boundary goes by an explicit rule: `overlap` to the section that holds most of its characters (the earlier one on
a tie), `first` to the one that holds its first character, `share` to each section in proportion to the characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

from .packing import _nullable
from .tokens import BYTE_FILE, encoder, vocabulary

RULES = ("overlap", "first", "share")


def lines(text: str) -> np.ndarray:
    """Starts of a text's lines; a line holds the line feed that ends it."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    return np.concatenate([[0], at[at < len(text)]]).astype(np.int64)


def attribute(spans: np.ndarray, starts: np.ndarray, end: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and of those how many cross a boundary. Sections start at `starts` (ascending, the first at
    0) and fill the text up to `end`. Empty spans belong where they stand."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    n = len(starts)
    head, last = spans[:, 0], np.maximum(spans[:, 1] - 1, spans[:, 0])
    a = np.searchsorted(starts, head, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    crosses = a != b
    counts = np.bincount(a[~crosses], minlength=n).astype(float)
    crossing = np.zeros(n)
    bounds = np.append(starts, end)
    for k in np.flatnonzero(crosses):
        over = np.arange(a[k], b[k] + 1)
        chars = np.minimum(bounds[over + 1], spans[k, 1]) - np.maximum(bounds[over], spans[k, 0])
        if rule == "share":
            counts[over] += chars / chars.sum()
            crossing[over] += 1
        else:
            to = a[k] if rule == "first" else over[int(np.argmax(chars))]
            counts[to] += 1
            crossing[to] += 1
    return counts, crossing.astype(np.int64)


def token_counts(
    docs: DataFrame,
    vocab: str = BYTE_FILE,
    rule: str = "overlap",
    sections: Callable[[str], np.ndarray] = lines,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, length (characters), n_tokens, n_crossing, doc_tokens.

    Null and empty texts give one empty section with no token. Repeated rows are counted each. An empty table gives no
    rows. Under each rule the sections of a document sum to its tokens. The work is one pass without a shuffle.
    """
    ship(docs.sparkSession)
    path = vocabulary(vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, words=False, offsets=True)
        for pdf in batches:
            ids_of, texts = pdf["doc_id"].array, [x if isinstance(x, str) else "" for x in pdf["text"]]
            for first, _, bounds, spans in enc.encode(texts):
                out = []
                for i in range(len(bounds) - 1):
                    whole, own = texts[first + i], spans[bounds[i] : bounds[i + 1]]
                    starts = sections(whole)
                    counts, crossing = attribute(own, starts, len(whole), rule)
                    out.append((np.full(len(starts), first + i), np.arange(len(starts)), starts, np.diff(np.append(starts, len(whole))), counts, crossing, np.full(len(starts), len(own))))
                at, k, start, long, counts, crossing, total = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"doc_id": ids_of.take(at), "section": k, "start": start, "length": long, "n_tokens": counts, "n_crossing": crossing, "doc_tokens": total})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(_nullable(run), "doc_id long, section int, start long, length long, n_tokens double, n_crossing long, doc_tokens long")
