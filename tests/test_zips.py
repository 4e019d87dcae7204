import io
import random
import zipfile

import pytest

from foliospark.sources import archives, zips


def made(path, members, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)


def damaged(path, name):
    """Changes one byte of a stored member, so that its checksum fails."""
    with zipfile.ZipFile(path) as z:
        at = z.getinfo(name).header_offset + 30 + len(name) + 1
    data = bytearray(path.read_bytes())
    data[at] ^= 1
    path.write_bytes(bytes(data))


def test_many_tasks_read_one_archive_by_ranges(spark, tmp_path):
    rng = random.Random(1)
    held = {f"d/m{i}.bin": rng.randbytes(rng.randint(0, 5000)) for i in range(80)}
    made(tmp_path / "a.zip", held)
    made(tmp_path / "b.zip", {"small": b"x"})
    made(tmp_path / "c.zip", {})
    df = zips.register(spark).read.format("zip_members").option("split", 7000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    got = [(r.source.rsplit("/", 1)[1], r.member, bytes(r.content), r.size, r.error) for r in df.collect()]
    want = [("a.zip", n, d, len(d), None) for n, d in held.items()] + [("b.zip", "small", b"x", 1, None)]
    assert sorted(got) == sorted(want)
    assert {r.source for r in df.collect()} <= {r.path for r in archives.archive_files(spark, str(tmp_path), "*.zip").select("path").collect()}
    assert df.where("member = 'd/m3.bin'").count() == 1 and df.select("member").count() == 81


def test_ranges_cover_each_file_once():
    sizes = [("a", 0), ("b", 5), ("c", 100), ("d", 10), ("e", 11), ("f", 30)]
    parts = zips.split_ranges(sizes, 10)
    flat = [r for p in parts for r in p]
    for path, size in sizes:
        own = sorted((lo, hi) for p, lo, hi in flat if p == path)
        assert own[0][0] == 0 and own[-1][1] is None and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert zips.split_ranges([], 10) == []


def test_damage_gives_error_rows_and_the_rest_is_read(spark, tmp_path):
    made(tmp_path / "a.zip", {"good": b"fine", "bad": b"abcdefgh", "last": b"also fine"})
    damaged(tmp_path / "a.zip", "bad")
    (tmp_path / "sub").mkdir()
    made(tmp_path / "whole.bin", {"x": b"0123456789" * 50})
    (tmp_path / "sub" / "cut.zip").write_bytes((tmp_path / "whole.bin").read_bytes()[:40])
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / "_hidden.zip").write_bytes(b"junk")
    made(tmp_path / "locked.zip", {"secret": b"data"})
    data = bytearray((tmp_path / "locked.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "locked.zip") as z:
        data[z.start_dir + 8] |= 1  # the flag of encryption
    (tmp_path / "locked.zip").write_bytes(bytes(data))
    # Spark's file source gives no row of an empty file
    for rows, seen in ((archives.read_members(spark, str(tmp_path)), {("empty.zip", None)}), (archives.members(archives.archive_files(spark, str(tmp_path), "*.zip")), set())):
        found = {(r.source.rsplit("/", 1)[1], r.member): (r.content and bytes(r.content), r.error) for r in rows.collect()}
        assert found["a.zip", "good"] == (b"fine", None) and found["a.zip", "last"] == (b"also fine", None)
        assert {k for k, (content, error) in found.items() if error} == {("a.zip", "bad"), ("cut.zip", None), ("locked.zip", "secret")} | seen
        assert all(content is None for content, error in found.values() if error)
        assert archives.broken(rows).count() == 3 + len(seen) and archives.archive_members(rows).count() == 2


def test_members_too_large_for_a_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zips, "MOST_CELL", 1000)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big", b"0" * 5000)
        z.writestr("fits", b"1" * 1000)
    archive = zipfile.ZipFile(out)
    assert zips.whole(archive, archive.getinfo("big"))[1] and zips.whole(archive, archive.getinfo("fits")) == (b"1" * 1000, None)


def test_lines_are_numbered_as_they_are_read(spark, tmp_path):
    text = "one\r\n\r\ntwo\n \nthree\r\r\nfour".encode() + b"\xff"
    made(tmp_path / "i.inpx", {"x/A.INP": text, "b.inp": b"", "c.txt": b"no", "d.inp": b"\n" * 30_000 + b"end\n"}, zipfile.ZIP_DEFLATED)
    made(tmp_path / "j.inpx", {"e.inp": b"".join(b"%d\n" % i for i in range(25_000))})
    damaged(tmp_path / "j.inpx", "e.inp")
    got = {(r.member, r.line_no, r.line) for r in archives.read_inpx(spark, str(tmp_path)).where("member <> 'e.inp'").collect()}
    assert got == {("x/A.INP", 0, "one"), ("x/A.INP", 2, "two"), ("x/A.INP", 3, " "), ("x/A.INP", 4, "three"), ("x/A.INP", 5, "four�"), ("d.inp", 30_000, "end")}
    assert [(r.member, r.error[:10]) for r in archives.broken(archives.read_index(spark, str(tmp_path))).collect()] == [("e.inp", "BadZipFile")]


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"d{i % 3}/a{i % 5}.zip", f"m{i:03}", bytes([i]) * i) for i in range(60)] + [("null.zip", "n", None)]
    zips.write_archives(spark.createDataFrame(rows, "archive string, member string, content binary").repartition(7), str(tmp_path / "out"))
    got = {("/".join(r.source.rsplit("/", 2)[1:]), r.member, bytes(r.content)) for r in archives.read_members(spark, str(tmp_path / "out")).collect()}
    assert got == {(a if "/" in a else f"out/{a}", m, c or b"") for a, m, c in rows}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d0", "d1", "d2", "null.zip"]


def test_a_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        archives.read_members(spark, str(tmp_path / "nowhere")).collect()


def test_range_of_a_batch_is_bounded(monkeypatch, tmp_path):
    monkeypatch.setattr(zips, "BATCH_BYTES", 100)
    made(tmp_path / "a.zip", {f"m{i}": b"x" * 40 for i in range(9)})
    reader = zips.ZipReader({"path": str(tmp_path)}, False)
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == 9 and max(sizes) <= 2
