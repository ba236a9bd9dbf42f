"""Whole-text encoding with public vocabulary files through the tokenizers library, with a cache of pieces.

Both vocabularies split a text before they merge, and never across the cuts made here, so the ids of a text are those of
its pieces in turn; tests hold them against the library on whole texts. Strings of the vocabulary's special tokens are cut
out first, as the library does, and stand for their token. Each worker keeps the ids of pieces it has met.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hold

#: Pieces that a worker's cache keeps; beyond it the cache starts anew, which costs time only.
CACHE_PIECES = 800_000
#: Longer pieces are encoded but not kept.
LONG_PIECE = 64
#: Characters that are taken up at a time.
SLICE_CHARS = 2_000_000

WORD_FILE, BYTE_FILE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Stands before the spaces at which a text is cut; a text that holds it is cut by the slower pattern.
_CUT = "\ue000"
_BLANK = re.compile(r"[ \n\t\r]")
_TWO_BLANKS = re.compile(r"\s\s")
#: Latin-1 letters, then marks: one or two words of the vocabulary that drops white space, so that many pieces can be encoded
#: as one text and told apart by the tokens that end a word.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([!-&(-/:-?]*)")
_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; a path is given back as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        return self.encoder.meet(piece)


class Encoder:
    """Ids of whole texts. `words`: a vocabulary that drops white space, cut at each white space; otherwise one that keeps
    it, cut before single spaces."""

    def __init__(self, path: str, words: bool, offsets: bool = False, most: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.offsets, self.most = words, offsets, most
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: added tokens that take up more than their own characters can't be cut out of a text")
        #: longest first, as the library matches them
        self.added = sorted((t.content for t in added), key=len, reverse=True)
        self.added_cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if words:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.known = _Known(self)
        self.new: list[str] = []
        self.count = 0
        self.first = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.span = np.zeros((1 << 14 if self.offsets else 0, 2), np.int32)
        self.filled = 0

    def meet(self, piece: str) -> int:
        at = self.count
        self.count += 1
        self.new.append(piece)
        if len(piece) <= LONG_PIECE:
            self.known[piece] = at
        return at

    def _cut(self, texts: list[str]) -> pa.ListArray:
        """The pieces of each text."""
        if any(a in t for a in self.added for t in texts):
            return pa.array([self._apart(t) for t in texts], pa.list_(pa.large_string()))
        if self.words:
            cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
            return pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        cut = []
        for t in texts:
            if _CUT in t:
                return pa.array([_SINGLE_SPACE.split(x) for x in texts], pa.list_(pa.large_string()))
            plain = t[:1] != " " and t[-1:] != " " and not _TWO_BLANKS.search(t)
            cut.append(t.replace(" ", _CUT + " ") if plain else _SINGLE_SPACE.sub(_CUT, t))
        return pc.split_pattern(pa.array(cut, pa.large_string()), _CUT)

    def _apart(self, text: str) -> list[str]:
        """The pieces of a text that may hold added tokens, each of these a piece of its own."""
        parts = self.added_cut.split(text) if self.added else [text]
        cut = _BLANK.split if self.words else _SINGLE_SPACE.split
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else cut(part))]

    def _learn(self) -> None:
        if self.count > len(self.first):
            more = np.zeros(max(self.count - len(self.first), len(self.first)), np.int64)
            self.first, self.size = np.concatenate([self.first, more]), np.concatenate([self.size, more])
        at = self.count - len(self.new)
        own = np.arange(at, self.count)
        kinds = [_PLAIN.fullmatch(p) if self.words else None for p in self.new]
        plain = np.array([k is not None for k in kinds], bool)
        words = np.array([1 + bool(k[1]) for k in kinds if k], np.int64)
        texts = np.array(self.new, object)
        self._learn_plain(own[plain], texts[plain], words)
        self._learn_others(own[~plain], texts[~plain].tolist())
        self.new = []

    def _keep(self, at: np.ndarray, n: np.ndarray, ids: np.ndarray, spans: np.ndarray | None = None) -> None:
        total = len(ids)
        if self.filled + total > len(self.ids):
            room = max(self.filled + total, 2 * len(self.ids)) - self.filled
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(room, np.uint32)])
            if self.offsets:
                self.span = np.concatenate([self.span[: self.filled], np.zeros((room, 2), np.int32)])
        self.ids[self.filled : self.filled + total] = ids
        if spans is not None:
            self.span[self.filled : self.filled + total] = spans
        self.first[at] = self.filled + np.cumsum(n) - n
        self.size[at] = n
        self.filled += total

    def _learn_plain(self, at: np.ndarray, texts: np.ndarray, words: np.ndarray) -> None:
        for i in range(0, len(at), 4096):
            part = slice(i, i + 4096)
            done = self.tokenizer.encode_batch_fast([" ".join(texts[part])], add_special_tokens=False)[0].ids
            ids = np.array(done, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            last = ends[np.cumsum(words[part]) - 1] + 1
            self._keep(at[part], np.diff(last, prepend=0), ids)

    def _learn_others(self, at: np.ndarray, texts: list[str]) -> None:
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        for i in range(0, len(texts), 4096):
            done = encode(texts[i : i + 4096], add_special_tokens=False)
            lists = [x.ids for x in done]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            spans = np.array([o for x in done for o in x.offsets], np.int32).reshape(-1, 2) if self.offsets else None
            self._keep(at[i : i + 4096], n, np.fromiter((t for x in lists for t in x), np.uint32, int(n.sum())), spans)

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        cut = self._cut(texts)
        # equal pieces are found before Python sees them
        flat = cut.flatten().dictionary_encode()
        kinds = np.fromiter(map(self.known.__getitem__, flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
        counts = np.concatenate([[0], pc.list_value_length(cut).to_numpy(zero_copy_only=False)]).astype(np.int64)
        codes = flat.indices.to_numpy()
        if self.new:
            self._learn()
        piece = kinds[codes]
        n = self.size[piece]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.first[piece] - (ends - n), n)
        bounds = np.concatenate([[0], ends])[np.cumsum(counts)]
        span = None
        if self.offsets:
            chars = pc.utf8_length(flat.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            before = np.cumsum(chars) - chars
            first = np.minimum(np.cumsum(counts)[:-1], max(len(before) - 1, 0))
            shift = before - np.repeat(before[first], counts[1:]) if len(before) else before
            span = self.span[at] + np.repeat(shift, n)[:, None]
        ids = self.ids[at]
        if self.count > self.most:
            self.reset()
        return ids, bounds, span

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Yields (first text, ids, bounds, spans) for slices of texts; text first + i has ids[bounds[i]:bounds[i + 1]]."""
        begin, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text)
            if chars >= SLICE_CHARS or i + 1 == len(texts):
                yield (begin, *self._some(texts[begin : i + 1]))
                begin, chars = i + 1, 0


_ENCODERS: dict[tuple[str, bool, bool, int], Encoder] = {}


def encoder(path: str, words: bool, offsets: bool = False, most: int = CACHE_PIECES) -> Encoder:
    """This worker's encoder for a vocabulary, with a cache of up to `most` pieces."""
    hold("tokens", _ENCODERS.clear)
    key = (path, words, offsets, most)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
