"""Archives are read forward, once for all of their members."""

import bz2
import gzip
import io
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skerry.sources import archives, extract
from skerry.sources.cache import UnitCache
from skerry.sources.files import WalkOptions, list_files


def write_tar(path, members, mode):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        d = tarfile.TarInfo("folder")
        d.type = tarfile.DIRTYPE
        t.addfile(d)


MEMBERS = [(f"d/m{i}.txt", f"line one of {i}\nline two of {i}".encode()) for i in range(60)]


class Counted(io.FileIO):
    """A file that counts the bytes that are read of it."""

    total = 0

    def read(self, n=-1):
        data = super().read(n)
        Counted.total += len(data)
        return data

    def readinto(self, b):
        n = super().readinto(b)
        Counted.total += n
        return n


@pytest.mark.parametrize("name, mode", [("a.tar", "w"), ("a.tar.gz", "w:gz"), ("a.tbz2", "w:bz2"), ("a.tar.xz", "w:xz")])
def test_a_stream_is_read_once_for_all_members(tmp_path, monkeypatch, name, mode):
    path = tmp_path / name
    noise = [(f"n{i}", bytes((i * j * j) % 251 for j in range(20_000))) for i in range(30)]
    write_tar(path, [*noise, *MEMBERS], mode)
    monkeypatch.setattr(archives, "_opened", lambda p: Counted(p))
    Counted.total = 0
    wanted = Counter(m for m, _ in archives.entries(str(path)))
    assert dict(archives.contents(str(path), wanted)) == dict([*noise, *MEMBERS])
    assert 0 < Counted.total <= path.stat().st_size
    Counted.total = 0
    assert [m for m, _ in archives.contents(str(path), {"n0": 1})] == ["n0"]
    assert mode != "w" or Counted.total < path.stat().st_size / 4  # the rest is not read


def test_repeated_names_faults_and_other_kinds(tmp_path):
    write_tar(tmp_path / "r.tar", [("a", b"first"), ("b", b"x"), ("a", b"last")], "w")
    assert Counter(m for m, _ in archives.entries(str(tmp_path / "r.tar"))) == {"a": 2, "b": 1}
    assert list(archives.contents(str(tmp_path / "r.tar"), {"a": 2, "b": 1})) == [("b", b"x"), ("a", b"last")]
    write_tar(tmp_path / "t.tar.gz", MEMBERS, "w:gz")
    whole = (tmp_path / "t.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(whole[: len(whole) // 2])
    assert archives.entries(str(tmp_path / "cut.tar.gz")) == []
    found = list(archives.contents(str(tmp_path / "cut.tar.gz"), dict.fromkeys(dict(MEMBERS), 1)))
    assert found == MEMBERS[: len(found)]  # what comes before the fault
    (tmp_path / "one.txt.gz").write_bytes(gzip.compress(b"alone"))
    assert list(archives.contents(str(tmp_path / "one.txt.gz"), {"one.txt": 1})) == [("one.txt", b"alone")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_BZIP2) as z:
        for n, d in MEMBERS:
            z.writestr(n, d)
    assert dict(archives.contents(str(tmp_path / "z.zip"), {"d/m3.txt": 1, "none": 1, "d/m9.txt": 1})) == {k: v for k, v in MEMBERS if k in ("d/m3.txt", "d/m9.txt")}
    (tmp_path / "bad.zip").write_bytes(b"PK" + bz2.compress(b"no"))
    assert list(archives.contents(str(tmp_path / "bad.zip"), {"x": 1})) == list(archives.contents(str(tmp_path / "none.tar"), {"x": 1})) == []


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    write_tar(root / "a.tar.gz", MEMBERS, "w:gz")
    write_tar(root / "e.tar", [], "w")
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        for n, d in MEMBERS:
            z.writestr(n, d)
    (root / "one.txt.gz").write_bytes(gzip.compress(b"alone\x0bnext"))
    (root / "plain.txt").write_text("here")
    return root


def _units(df, files):
    return sorted((r["rel_path"], r["line_number"], r["text"]) for r in df.join(files.select("file_id", "rel_path"), "file_id").collect())


def test_units_of_members_in_one_pass(spark, tree, monkeypatch):
    files = list_files(spark, str(tree), WalkOptions(include_archives=True))
    want = [(f"{a}::{m}", k, t) for a in ("a.tar.gz", "z.zip") for m, d in MEMBERS for k, t in enumerate(d.decode().split("\n"), 1)]
    want += [("one.txt.gz::one.txt", 1, "alone"), ("one.txt.gz::one.txt", 2, "next"), ("plain.txt", 1, "here")]
    # archives are no text: what is left of their own lines is not looked at here
    got = [u for u in _units(extract.units(files), files) if "::" in u[0] or u[0] == "plain.txt"]
    assert got == sorted(want)
    members = files.where(F.col("archive").isNotNull())
    rows = archives.grouped(members).collect()
    assert sorted((r["archive"].rsplit("/", 1)[1], len(r["found"])) for r in rows) == [("a.tar.gz", 60), ("one.txt.gz", 1), ("z.zip", 60)]
    monkeypatch.setattr(archives, "RANGE_BYTES", 300)
    parts = [len(r["found"]) for r in archives.grouped(members).collect() if r["archive"].endswith(".zip")]
    assert len(parts) >= 5 and sum(parts) == 60 and max(parts) <= 12
    assert [u for u in _units(extract.units(files, with_archives=False), files) if "::" in u[0]] == []


def test_limits_of_members(spark, tree):
    files = list_files(spark, str(tree), WalkOptions(include_archives=True))
    small = {u[0] for u in _units(extract.units(files, want=extract.Wanted(max_bytes=28)), files) if "::" in u[0]}
    sizes = {r["rel_path"]: r["size_bytes"] for r in files.where("archive IS NOT NULL").collect()}
    assert small == {p for p, n in sizes.items() if n <= 28} and len(small) not in (0, len(sizes))


def test_the_cache_hashes_members_in_one_pass(spark, tree, tmp_path):
    files = list_files(spark, str(tree), WalkOptions(include_archives=True))
    cache = UnitCache(spark, str(tmp_path / "cache"))
    first = _units(cache.units(files), files)
    assert first == _units(extract.units(files), files) == _units(cache.units(files), files)
    hashes = {r["path"].rsplit("/", 1)[-1]: r["content_hash"] for r in cache.hashed(files).collect()}
    assert len({h for p, h in hashes.items() if p.endswith("m7.txt")}) == 1
