"""Digests of byte ranges against hashlib."""

import hashlib
import random

import pytest

from tidemark.sources import digests as D

hexed = lambda b: hashlib.sha256(b).hexdigest()


def root_of(data, size, fanout):
    level = [hexed(data[i : i + size]) for i in range(0, len(data), size)]
    while len(level) > 1:
        level = [hexed("".join(level[i : i + fanout]).encode()) for i in range(0, len(level), fanout)]
    return level[0]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(4)
    at = tmp_path / "data set"
    (at / "in side").mkdir(parents=True)
    files = {"one range": 90, "exact": 400, "empty": 0, "in side/many": 100 * 37 + 11, "in side/five": 100 * 5}
    for name, n in files.items():
        (at / name).write_bytes(rng.randbytes(n))
    return at


def test_ranges_and_roots(spark, folder, tmp_path):
    stored = D.record(spark, str(folder), str(tmp_path / "ranges"), 100)
    data = {str(f.relative_to(folder)): f.read_bytes() for f in folder.rglob("*") if f.is_file() and f.stat().st_size}
    want = {(n, i // 100, i): (min(100, len(d) - i), hexed(d[i : i + 100])) for n, d in data.items() for i in range(0, len(d), 100)}
    assert {(r.name, r.part, r.start): (r.bytes, r.sha256) for r in stored.collect()} == want
    for fanout in (2, 4, 256):
        assert {r.name: (r.bytes, r.n_ranges, r.root) for r in D.roots(stored, fanout).collect()} == {n: (len(d), -(-len(d) // 100), root_of(d, 100, fanout)) for n, d in data.items()}
    assert {r.name: (r.bytes, r.sha256) for r in D.streamed_sha256(spark, str(folder)).collect()} == {n: (len(d), hexed(d)) for n, d in data.items()}
    single = D.streamed_sha256(spark, str(folder / "exact")).collect()
    assert [(r.name, r.sha256) for r in single] == [("exact", hexed(data["exact"]))]


def test_altered_ranges_are_named(spark, folder, tmp_path):
    at = str(tmp_path / "ranges")
    D.record(spark, str(folder), at, 100)
    moved = folder.rename(tmp_path / "moved")
    D.verify(spark, str(moved), at, 100)
    many = bytearray((moved / "in side/many").read_bytes())
    many[250] ^= 1
    many[3699] ^= 1
    (moved / "in side/many").write_bytes(many + b"x")  # two ranges altered, and the last one longer
    (moved / "in side/five").write_bytes((moved / "in side/five").read_bytes()[:350])
    (moved / "exact").unlink()
    (moved / "new").write_bytes(b"n")
    got = {(r.name, r.part, r.status) for r in D.altered(D.recorded(spark, at), D.ranges(spark, str(moved), 100)).collect()}
    assert got == {("in side/many", 2, "altered"), ("in side/many", 36, "altered"), ("in side/many", 37, "altered"), ("in side/five", 3, "altered"), ("in side/five", 4, "removed"), ("new", 0, "added")} | {("exact", i, "removed") for i in range(4)}
    with pytest.raises(ValueError, match="exact from byte 0 removed"):
        D.verify(spark, str(moved), at, 100)


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stored = D.record(spark, str(tmp_path / "none"), str(tmp_path / "ranges"), 100)
    assert stored.count() == 0 and D.roots(stored).count() == 0


def test_a_file_beyond_what_a_row_can_hold(spark, tmp_path):
    """2.5 GB, nearly all of it a hole."""
    big = tmp_path / "big" / "file"
    big.parent.mkdir()
    with open(big, "wb") as f:
        f.truncate(5 << 29)
    at = str(tmp_path / "ranges")
    D.record(spark, str(big), at)
    assert [(r.bytes, r.n_ranges) for r in D.roots(D.recorded(spark, at)).collect()] == [(5 << 29, 40)]
    with open(big, "r+b") as f:
        f.seek((1 << 31) + 5)
        f.write(b"!")
    assert [(r.part, r.start, r.status) for r in D.altered(D.recorded(spark, at), D.ranges(spark, str(big))).collect()] == [(32, 1 << 31, "altered")]
