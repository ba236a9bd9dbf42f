"""Archives by index and range reads: many tasks for one archive, bounds, archives within archives."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from strataloom.sources import archives


def _zip(entries, kind=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", kind) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def _tar(entries, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    plain = [(f"dir/f{i}.txt", f"body {i}".encode()) for i in range(50)]
    nested = _zip([("deep.txt", b"deep"), ("more.tar", _tar([("bottom.txt", b"bottom"), ("last.zip", _zip([("x", b"x")]))], "w"))])
    data = {
        "many.zip": _zip([(f"m{i:05d}.txt", b"%d" % i * 20) for i in range(10_000)]), "plain.tar": _tar(plain, "w"), "packed.tar.gz": _tar([*plain, ("../up.txt", b"no")], "w:gz"),
        "bomb.zip": _zip([("zeros", b"\0" * (5 << 20)), ("fine.txt", b"fine"), ("/etc/passwd", b"no"), ("a/../../b", b"no")]), "nested.zip": _zip([("in/side.zip", nested), ("flat.txt", b"flat")]),
        "broken.zip": b"PK not a zip", "other.7z": b"7z", "empty.zip": _zip([]), "half.tar.gz": _tar(plain, "w:gz")[:200],
    }
    for name, body in data.items():
        (at / name).write_bytes(body)
    return at


def _names(spark, folder, *names):
    return spark.createDataFrame([(str(folder / n),) for n in names], "path string")


def test_one_archive_is_read_by_several_tasks(spark, folder):
    listed = archives.index(_names(spark, folder, "many.zip"))
    got = archives.members(listed, task_bytes=100_000).withColumn("task", F.spark_partition_id())
    rows = got.agg(F.count("*"), F.count_distinct("member"), F.count_distinct("task"), F.sum(F.length("content"))).first()
    assert rows[0] == rows[1] == 10_000 and rows[2] > 1 and rows[3] == sum(len(str(i)) * 20 for i in range(10_000))
    assert got.where("member = 'm00123.txt'").first()["content"] == b"123" * 20


def test_kinds_bounds_and_nesting(spark, folder):
    names = ["plain.tar", "packed.tar.gz", "bomb.zip", "nested.zip", "broken.zip", "other.7z", "empty.zip", "half.tar.gz"]
    listed = archives.index(_names(spark, folder, *names))
    rows = [(r["archive"].rpartition("/")[2], r["member"], r["folder"], r["status"], r["content"]) for r in archives.members(listed).collect()]
    by = {n: [r[1:] for r in rows if r[0] == n] for n in names}
    plain = {(f"dir/f{i}.txt", "ok", b"body %d" % i) for i in range(50)}
    assert {(m, s, bytes(c)) for m, _, s, c in by["plain.tar"]} == plain and {f for _, f, _, _ in by["plain.tar"]} == {"plain"}
    assert {(m, s, c and bytes(c)) for m, _, s, c in by["packed.tar.gz"]} == plain | {("../up.txt", "unsafe", None)}
    assert {(m, s) for m, _, s, _ in by["bomb.zip"]} == {("zeros", "bursts"), ("fine.txt", "ok"), ("/etc/passwd", "unsafe"), ("a/../../b", "unsafe")}
    assert {(m, f, s) for m, f, s, _ in by["nested.zip"]} == {
        ("flat.txt", "nested", "ok"), ("in/side.zip!/deep.txt", "nested/in/side", "ok"), ("in/side.zip!/more.tar", "nested/in/side", "too deep"),
    }
    assert [s[:10] for _, _, s, _ in by["broken.zip"]] == ["unreadable"] and [s for _, _, s, _ in by["other.7z"]] == ["unsupported"]
    assert by["empty.zip"] == [] and by["half.tar.gz"][-1][2].startswith("unreadable")
    deeper = archives.members(listed.where(F.col("archive").endswith("nested.zip")), archives.Bounds(depth=4)).where("status = 'ok'")
    assert {r["member"] for r in deeper.collect()} == {"flat.txt", "in/side.zip!/deep.txt", "in/side.zip!/more.tar!/bottom.txt", "in/side.zip!/more.tar!/last.zip!/x"}


def test_limits_of_an_archive(spark, folder):
    few = archives.index(_names(spark, folder, "plain.tar"), bounds=archives.Bounds(total_bytes=100))
    told = {r["status"]: r["count"] for r in few.groupBy("status").count().collect()}
    assert told == {"ok": 15, "over the archive's limit": 35}  # ten of 6 bytes, five of 7
    bound = archives.Bounds(members=10)
    got = archives.members(archives.index(_names(spark, folder, "packed.tar.gz"), bounds=bound), bound).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"ok": 10, "over the archive's limit": 1}
    large = archives.index(_names(spark, folder, "bomb.zip"), bounds=archives.Bounds(member_bytes=1 << 20))
    assert large.where("member = 'zeros'").first()["status"] == "too large"
    assert archives.members(archives.index(spark.createDataFrame([], "path string"))).count() == 0


def test_what_is_written_is_read_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{i % 3}.zip", f"d/{i}.txt", b"x" * i) for i in range(40)], "archive string, member string, content binary")
    made = archives.write_zips(rows, str(tmp_path / "zips"))
    got = archives.members(archives.index(made))
    assert {(r["archive"].rpartition("/")[2], r["member"], bytes(r["content"])) for r in got.collect()} == {(f"a{i % 3}.zip", f"d/{i}.txt", b"x" * i) for i in range(40)}


def test_members_are_read_by_what_the_index_tells(spark, tmp_path):
    """A task of a large archive would read the whole directory for its few members; the index of many is read by many tasks."""
    for k in range(12):
        (tmp_path / f"a{k}.zip").write_bytes(_zip([("ä.txt", b"one" * 50), ("b.txt", b""), ("c.txt", b"two" * 50)], zipfile.ZIP_STORED if k % 2 else zipfile.ZIP_DEFLATED))
    listed = archives.index(_names(spark, tmp_path, *(f"a{k}.zip" for k in range(12))))
    assert listed.select(F.spark_partition_id()).distinct().count() > 1
    listed.write.parquet(str(tmp_path / "listed"))
    for k in range(12):  # without their directories
        whole = (tmp_path / f"a{k}.zip").read_bytes()
        (tmp_path / f"a{k}.zip").write_bytes(whole[: whole.index(b"PK\x01\x02")])
    body = bytearray((tmp_path / "a1.zip").read_bytes())
    body[-10] ^= 1
    (tmp_path / "a1.zip").write_bytes(bytes(body))
    got = archives.members(spark.read.parquet(str(tmp_path / "listed")), task_bytes=100)
    rows = sorted((r["archive"].rpartition("/")[2], r["member"], r["status"], bytes(r["content"] or b"")) for r in got.collect())
    want = [(f"a{k}.zip", m, "ok", c) for k in range(12) for m, c in (("ä.txt", b"one" * 50), ("b.txt", b""), ("c.txt", b"two" * 50))]
    assert rows == sorted(r if r[:2] != ("a1.zip", "c.txt") else (*r[:2], "unreadable: BadZipFile", b"") for r in want)
