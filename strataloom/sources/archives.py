"""Archives whose members are read by many tasks: an index by range reads, then members dealt by size.

index() reads the central directory of a zip file, or walks the headers of a tar file, without reading what lies between;
members() deals what is safe to take to tasks, each of which opens its archives and reads only its members, at the places
that the index tells. A tar.gz has no places to begin at, so it is one unit of work, streamed member by member. Nothing holds
a whole archive. What is not taken has a row with its reason.
"""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import ship

#: Bytes of members that one task takes, about.
TASK_BYTES = 64 << 20
#: Rows and bytes of members that a task hands on together, at most but for one.
OUT_ROWS, OUT_BYTES = 1000, 4 << 20
ZIP, TAR, STREAM = "zip", "tar", "tar.gz"
_INDEX = "archive string, number int, member string, kind string, place long, size long, packed long, status string, before long, method int, crc long"
_OUT = "archive string, member string, folder string, status string, content binary"


@dataclass(frozen=True)
class Bounds:
    """Limits against archives that burst: bytes of a member and of all members of an archive, how much larger than packed
    a member may be (small ones always may), members of an archive, and archives within archives."""

    member_bytes: int = 64 << 20
    total_bytes: int = 4 << 30
    ratio: float = 200.0
    members: int = 1_000_000
    depth: int = 2


def kind_of(path: str) -> str | None:
    low = path.lower()
    return ZIP if low.endswith(".zip") else TAR if low.endswith(".tar") else STREAM if low.endswith((".tar.gz", ".tgz")) else None


class _Ranges(io.RawIOBase):
    """A file of a store that is read in ranges; a wrong place is an OSError, as zipfile expects it."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(at)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            self.file.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(path: str) -> io.BufferedReader:
    return io.BufferedReader(_Ranges(path), 1 << 16)


def safe_name(name: str) -> bool:
    """Whether a member stays below the folder that it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


def _refused(name: str, size: int, packed: int, bounds: Bounds) -> str:
    if not safe_name(name):
        return "unsafe"
    if size > bounds.member_bytes:
        return "too large"
    if size > 1 << 20 and size > bounds.ratio * max(packed, 1):
        return "bursts"
    return "ok"


def _listed(path: str, bounds: Bounds) -> Iterator[tuple]:
    kind = kind_of(path)
    if kind is None:
        yield path, 0, None, None, 0, 0, 0, "unsupported", 0, None, None
    elif kind == STREAM:
        yield path, 0, None, STREAM, 0, 0, 0, "ok", 0, None, None
    else:
        with _open(path) as f:
            if kind == ZIP:
                with zipfile.ZipFile(f) as z:
                    found = [(i.filename, i.header_offset, i.file_size, i.compress_size, bool(i.flag_bits & 1), i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir()]
            else:
                with tarfile.open(fileobj=f, mode="r:") as t:
                    found = [(m.name, m.offset_data, m.size, m.size, False, None, None) for m in t if m.isreg()]
        total = before = 0
        for i, (name, place, size, packed, locked, method, crc) in enumerate(found):
            status = "locked" if locked else _refused(name, size, packed, bounds)
            total += size if status == "ok" else 0
            status = "over the archive's limit" if status == "ok" and (total > bounds.total_bytes or i >= bounds.members) else status
            before += size if status == "ok" else 0
            yield path, i, name, kind, place, size, packed, status, before, method, crc


def index(archives: DataFrame, path: str = "path", bounds: Bounds = Bounds()) -> DataFrame:
    """(archive, number, member, kind, place, size, packed, status, before, method, crc) of every member, `before` being the bytes
    of the safe ones up to it; an archive that can't be read has one row with its reason. Only names of the archives are needed
    of the rows, which are dealt to the default number of tasks however short they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in pdf[path]:
                try:
                    rows = list(_listed(at, bounds))
                except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError, NotImplementedError) as e:
                    rows = [(at, 0, None, None, 0, 0, 0, f"unreadable: {type(e).__name__}", 0, None, None)]
                pdf = pd.DataFrame(rows, columns=[x.split()[0] for x in _INDEX.split(", ")])
                yield pdf.astype({"method": "Int32", "crc": "Int64"})

    ship(archives.sparkSession)
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = archives.select(path).where(F.col(path).isNotNull()).repartition(tasks, path).distinct()
    return spread.mapInPandas(run, _INDEX)


def folder_of(path: str) -> str:
    """What an archive is unpacked to: its name without the ending."""
    name = path.rpartition("/")[2]
    return name[: -len(next((e for e in (".tar.gz", ".tgz", ".zip", ".tar") if name.lower().endswith(e)), ""))] or name


def _inner(path: str, name: str, folder: str, data: bytes, bounds: Bounds, depth: int) -> Iterator[tuple]:
    """A member, or what is in it if it is an archive itself, `depth` archives deep at most."""
    kind = kind_of(name)
    if kind is None or depth >= bounds.depth:
        yield path, name, folder, "ok" if kind is None else "too deep", data if kind is None else None
        return
    inside = f"{folder}/{name.rpartition('/')[0]}/{folder_of(name)}".replace("//", "/")
    total = 0
    try:
        for inner, size, packed, read in _unpacked(io.BytesIO(data), kind):
            status = _refused(inner, size, packed, bounds)
            total += size if status == "ok" else 0
            status = "over the archive's limit" if status == "ok" and total > bounds.total_bytes else status
            if status != "ok":
                yield path, f"{name}!/{inner}", inside, status, None
                continue
            for row in _inner(path, inner, inside, read(), bounds, depth + 1):
                yield path, f"{name}!/{row[1]}", *row[2:]
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError, RuntimeError) as e:
        yield path, name, inside, f"unreadable: {type(e).__name__}", None


def _unpacked(file, kind: str) -> Iterator[tuple]:
    """(name, size, packed, reader) of the members of an open archive, one after another."""
    if kind == ZIP:
        with zipfile.ZipFile(file) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, i.file_size, i.compress_size, lambda i=i: z.read(i)
    else:
        flat = gzip.GzipFile(fileobj=file) if kind == STREAM else file
        with tarfile.open(fileobj=flat, mode="r:" if kind == TAR else "r|") as t:
            for m in t:
                if m.isreg():
                    yield m.name, m.size, m.size, lambda m=m: t.extractfile(m).read()
        while kind == STREAM and flat.read(1 << 16):
            pass  # a stream that breaks off says so at its end only


def _plain(f, name: str, place: int, size: int, packed: int, method: int, crc: int) -> bytes:
    """A stored or deflated member of a zip file, read by what the index tells: the directory of a large archive would cost
    each task more than its members."""
    f.seek(place)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member begins here")
    flags, n, extra = *struct.unpack("<H", head[6:8]), *struct.unpack("<HH", head[26:30])
    told = f.read(n).decode("utf-8" if flags & 0x800 else "cp437", "replace").split("\0")[0]
    if told != name:
        raise zipfile.BadZipFile("another member begins here")
    f.seek(place + 30 + n + extra)
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompressobj(-15).decompress(data, size + 1)
        except zlib.error as e:
            raise zipfile.BadZipFile(str(e)) from e
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("bad sum")
    return data


def members(listed: DataFrame, bounds: Bounds = Bounds(), task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, member, folder, status, content) of an index's members. Safe ones are dealt to tasks by the bytes before
    them in their archive, so that a large archive is read by many tasks; a task holds a few members at a time. The index is read once."""
    tasks = max(1, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = listed.withColumn("part", F.floor(F.col("before") / task_bytes)).repartition(tasks, "archive", "part").sortWithinPartitions("archive", "number")
    names = [x.split()[0] for x in _OUT.split(", ")]

    def taken(path: str, rows: pd.DataFrame) -> Iterator[tuple]:
        folder, kind = folder_of(path), rows["kind"].iloc[0]
        with _open(path) as f:
            if kind == STREAM:
                yield from _streamed(path, folder, f, bounds)
                return
            infos = None
            for name, place, size, packed, method, crc in rows[["member", "place", "size", "packed", "method", "crc"]].itertuples(index=False, name=None):
                try:
                    if kind == ZIP and method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        data = _plain(f, name, place, size, packed, method, crc)
                    elif kind == ZIP:
                        z = z if infos else zipfile.ZipFile(f)
                        infos = infos or {i.header_offset: i for i in z.infolist()}
                        data = z.read(infos[place])
                    else:
                        f.seek(place)
                        data = f.read(size)
                except (zipfile.BadZipFile, OSError, EOFError, RuntimeError, NotImplementedError) as e:
                    yield path, name, folder, f"unreadable: {type(e).__name__}", None
                    continue
                yield from _inner(path, name, folder, data, bounds, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held += [(a, m, None, status, None) for a, m, status in pdf[pdf["status"] != "ok"][["archive", "member", "status"]].itertuples(index=False, name=None)]
            for path, rows in pdf[pdf["status"] == "ok"].groupby("archive", sort=False):
                for row in taken(path, rows):
                    held.append(row)
                    size += len(row[4] or b"")
                    if len(held) >= OUT_ROWS or size >= OUT_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
        yield pd.DataFrame(held, columns=names)

    return dealt.mapInPandas(run, _OUT)


def _streamed(path: str, folder: str, file, bounds: Bounds) -> Iterator[tuple]:
    total = n = 0
    try:
        for name, size, _, read in _unpacked(file, STREAM):
            n += 1
            status = _refused(name, size, size, bounds)
            total += size if status == "ok" else 0
            if status == "ok" and (total > bounds.total_bytes or n > bounds.members):
                # what comes after would have to be unpacked to be passed over
                yield path, name, folder, "over the archive's limit", None
                return
            if status != "ok":
                yield path, name, folder, status, None
            else:
                yield from _inner(path, name, folder, read(), bounds, 1)
    except (tarfile.TarError, EOFError, OSError, ValueError) as e:
        yield path, None, folder, f"unreadable: {type(e).__name__}", None


def write_zips(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (archive, member, content) as zip files below a folder that executors share, one task per archive, members
    as they come; gives their `path`. A task that runs again writes the same file again. Compute it once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, name, at = None, None, fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        at[0].create_dir(at[1], recursive=True)

        def closed(archive: zipfile.ZipFile, out, path: str) -> pd.DataFrame:
            archive.close()
            out.close()
            return pd.DataFrame({"path": [path]})

        for pdf in batches:
            for archive, member, content in zip(pdf["archive"], pdf["member"], pdf["content"]):
                if archive != name:
                    if z is not None:
                        yield closed(z, out, f"{folder}/{name}")
                    out = at[0].open_output_stream(f"{at[1]}/{archive}")
                    z, name = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), archive
                z.writestr(zipfile.ZipInfo(member), content, zipfile.ZIP_DEFLATED)
        if z is not None:
            yield closed(z, out, f"{folder}/{name}")

    ship(rows.sparkSession)
    spread = rows.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member")
    made = spread.mapInPandas(run, "path string")
    at = f"{folder}-names"
    made.write.mode("overwrite").parquet(at)
    return rows.sparkSession.read.parquet(at)
