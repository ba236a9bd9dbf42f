"""Words of Arrow texts as numbers and hashes of n-grams, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time; a longer text is cut alone.
SLICE_BYTES = 3_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = np.random.default_rng(1212).integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


@dataclass
class Words:
    """The words of some texts in order: `ids` into `vocabulary`, the text each stands in, and its piece (words of one
    piece have nothing but gaps between them)."""

    vocabulary: pa.Array
    ids: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word of the vocabulary."""
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end): runs of rows with up to `most` bytes, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, most + (ends[begin - 1] if begin else 0), "right")))
        yield begin, end
        begin = end


def cut(texts: pa.Array, gaps: bytes, stops: bytes = b"") -> Words:
    """Lower-cases A-Z and cuts texts (nulls are empty) into the longest runs without the ASCII bytes of gaps and stops;
    stops part pieces as well."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    empty = np.zeros(0, np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return Words(pa.array([], pa.large_binary()), empty, empty, empty)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    kind = np.zeros(256, np.uint8)
    kind[list(gaps)], kind[list(stops)] = 1, 2
    kind = kind[data]
    # a place between two bytes is an edge if one side is inside a word and the other not, or a text ends there
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    first, last = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    first[at] |= inside[1:][at]
    last[at] |= inside[:-1][at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return Words(pa.array([], pa.large_binary()), empty, empty, empty)
    runs = np.empty(2 * len(starts), np.int64)
    runs[0::2], runs[1::2] = starts, ends
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(runs) - 1, [None, pa.py_buffer(runs), pa.py_buffer(data)])
    coded = words.take(pa.array(np.arange(0, len(runs), 2))).dictionary_encode()
    text = np.searchsorted(at, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), text, piece)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, seed: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of the n consecutive words that begin at each place but the last n - 1, from the words' hashes; `seed` is one
    for each of these places, or one for all."""
    m = max(len(words) - n + 1, 0)
    total = np.full(m, n, np.uint64) + (np.asarray(seed, np.uint64) if np.isscalar(seed) else seed[:m])
    with np.errstate(over="ignore"):
        for i in range(n if m else 0):
            total = total + mixed(words[i : i + m]) * _PLACE[i % 64]
        return mixed(total)
