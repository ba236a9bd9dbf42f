"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum per frame.

Layout of a file: frames; a skippable frame with the document index; a skippable frame with the seek table. The seek table
follows the published seekable format of zstandard: per frame its compressed size, its size and the low 32 bits of XXH64
of its content, then the number of frames, a descriptor byte and a magic number. The document index (itself one
zstandard frame) has per document its id, whether that is null, its tokens and its frame; documents fill frames whole. A
reader takes the tables from the file's end and decompresses the frames of the documents it is asked for.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, ship
from .packing import _nullable
from .tokens import WORD_FILE, crc, encoder, vocabulary

# fixed values of the published seekable format
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = 0x184D2A50
#: Bytes of ids after which a frame ends, and documents that a file holds, about.
FRAME_BYTES, FILE_DOCS = 1 << 18, 16_384
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u4"), ("frame", "<u4")])


def _open(path: str, mode: str):
    """(file, path there) on whatever store the path names: a scheme that pyarrow knows, or local files."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "w":
        store.create_dir(at.rpartition("/")[0], recursive=True)
    return store, at


class Writer:
    """Writes one file; it appears under its name only when it is whole."""

    def __init__(self, path: str, wide: bool):
        self.store, self.path = _open(path, "w")
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.temp)
        self.dtype = "<u4" if wide else "<u2"
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.held: list[bytes] = []
        self.size = self.tokens = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(self.dtype).tobytes()
        self.index.append((doc_id or 0, doc_id is None, len(ids), len(self.frames)))
        self.held.append(data)
        self.size += len(data)
        self.tokens += len(ids)
        if self.size >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        if self.held:
            data = b"".join(self.held)
            packed = self.zstd.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._frame()
        body = struct.pack("<B", 4 if self.dtype == "<u4" else 2) + self.zstd.compress(np.array(self.index, _ENTRY).tobytes())
        self.out.write(struct.pack("<II", INDEX, len(body)) + body)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.store.move(self.temp, self.path)


    def abandon(self) -> None:
        """Removes what a failed task has written."""
        self.out.close()
        self.store.delete_file(self.temp)


class Reader:
    """Reads one file. Frames are decompressed as documents of theirs are asked for, each checked against the table."""

    def __init__(self, path: str):
        store, at = _open(path, "r")
        self.file = store.open_input_file(at)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        self.frames = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.cumsum(self.frames[:, 0]) - self.frames[:, 0] if n else np.zeros(0, np.int64)
        at = int(self.frames[:, 0].sum())
        kind, size = struct.unpack("<II", self._at(at, 8))
        if kind != INDEX:
            raise ValueError(f"{path} has no document index")
        body = self._at(at + 8, size)
        self.dtype = "<u4" if body[0] == 4 else "<u2"
        self.zstd = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.zstd.decompress(body[1:]) if len(body) > 1 else b"", _ENTRY)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = (int(x) for x in self.frames[k])
        data = self.zstd.decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, self.dtype).astype(np.uint32)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the file's order: all, or those whose id is wanted."""
        entries = self.index
        tokens = entries["tokens"].astype(np.int64)
        frame_first = np.searchsorted(entries["frame"], entries["frame"], "left")
        ends = np.cumsum(tokens)
        starts = ends - tokens
        pick = np.arange(len(entries))
        if wanted is not None:
            pick = pick[np.isin(entries["doc_id"], np.array(list(wanted), np.int64)) & (entries["null"] == 0)]
        held, data = -1, np.zeros(0, np.uint32)
        for i in pick:
            if (k := int(entries["frame"][i])) != held:
                held, data = k, self.frame(k)
            at = int(starts[i] - starts[frame_first[i]])
            yield None if entries["null"][i] else int(entries["doc_id"][i]), data[at : at + int(tokens[i])]

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, folder: str, vocab: str = WORD_FILE, end_id: int = 1, file_docs: int = FILE_DOCS, doc_id: str = "doc_id", text: str = "text", n_docs: int | None = None
) -> DataFrame:
    """Writes the ids of whole texts, each with end_id after them, to files in ascending doc_id order (null first) and
    returns the manifest: part, path, docs, tokens. Null texts count as empty; rows that repeat an id stand by a hash of the
    text. Very long texts are encoded whole and fill a frame of their own. An empty table writes no file.

    The files are written when the manifest is computed: store it before reading it twice. A task that runs again writes
    the same file under the same name. `folder` must be one that all executors share.
    """
    ship(docs.sparkSession)
    path = vocabulary(vocab)
    n = docs.count() if n_docs is None else n_docs
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # ranges go by text too, so that rows of one id, or of none, can fill several files
    rows = rows.withColumn("by", F.xxhash64("text"))
    sorted_ = rows.repartitionByRange(max(1, -(-n // file_docs)), "doc_id", "by").sortWithinPartitions("doc_id", "by").drop("by")
    sorted_ = sorted_.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, writer, docs_, part = encoder(path, words=True), np.array([end_id], np.uint32), None, 0, 0
        wide = enc.tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        try:
            for pdf in batches:
                if writer is None and len(pdf):
                    part = int(pdf["part"].iloc[0])
                    name = f"{folder}/part-{part:06d}.zst"
                    writer = Writer(name, wide)
                ids_of = pdf["doc_id"].array
                for first, ids, bounds, _ in enc.encode(pdf["text"].to_list()):
                    for i in range(len(bounds) - 1):
                        key = ids_of[first + i]
                        writer.add(None if pd.isna(key) else int(key), np.concatenate([ids[bounds[i] : bounds[i + 1]], end]))
                        docs_ += 1
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.abandon()
            raise
        if writer is not None:
            yield pd.DataFrame({"part": [part], "path": [name], "docs": [docs_], "tokens": [writer.tokens]})

    return sorted_.mapInPandas(_nullable(run), "part int, path string, docs long, tokens long")


def read_token_files(manifest: DataFrame, files: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of a manifest; start counts the
    ids of all documents before. One row per file passes through the window."""
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0))).select("part", "path", "base")
    dealt = based.repartition(max(1, files), "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["base"]):
                reader, rows = Reader(path), []
                for key, ids in reader.documents():
                    rows.append((key, start, len(ids), crc(ids)))
                    start += len(ids)
                reader.close()
                key, first, n, check = zip(*rows) if rows else ((), (), (), ())
                yield pd.DataFrame({"doc_id": pd.array(key, "Int64"), "start": first, "n_tokens": n, "ids_crc32": check})

    return dealt.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """Writes docs to files in the shared folder and gives back what a reader finds in them."""
    scratch = scratch or Scratch(docs.sparkSession, "token-files")
    manifest = scratch.keep(write_token_files(docs, scratch.path("files"), **how), "manifest")
    return read_token_files(manifest, manifest.count())
