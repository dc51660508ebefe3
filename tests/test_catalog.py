"""Catalog text, read and written."""

import pytest

from sectorloom.kernels.catalog_text import Catalog, emit, extents, parse
from sectorloom.kernels.codec import Malformed


def sample() -> Catalog:
    entries = [{"entry_key": 0, "parent_key": None, "depth": 0, "child_ordinal": 0, "type": "directory"}]
    entries += [{"entry_key": 1, "parent_key": 0, "depth": 1, "child_ordinal": 0, "identifier": (1 << 64) - 1, "name": "docs", "type": "directory"}]
    entries += [{"entry_key": 2, "parent_key": 1, "depth": 2, "child_ordinal": 0, "name": "a.txt", "type": "file", "size": 11, "extents": [(16, 11, False), (0, 4, True)], "source_identifier": 1, "subject_identifier": 7, "permission_group_index": -1, "short_name": "A~1.TXT", "md5": "ab" * 16, "creation_time": -5}]
    entries += [{"entry_key": 3, "parent_key": 0, "depth": 1, "child_ordinal": 1, "name": "é中", "type": "file"}]
    groups = [{"name": "admins", "property_type": 10, "permissions": [{"name": "alice", "identifier": "S-1", "property_type": 1, "access_mask": 2032127, "ace_flags": 3}]}]
    return Catalog(1000, entries, [{}, {"identifier": 1, "name": "disk", "drive_type": "f", "size": 5}], [{}, {"identifier": 7, "name": "subject"}], groups)


def test_round_trip():
    c = sample()
    got = parse(emit(c))
    assert got == c


def test_deep_trees_need_no_recursion():
    c = sample()
    c.entries = [{"entry_key": i, "parent_key": i - 1 if i else None, "depth": i, "child_ordinal": 0} for i in range(5000)]
    assert parse(emit(c)).entries[-1]["depth"] == 4999


@pytest.mark.parametrize(("old", "new", "what"), [("5\n", "4\n", "category count"), ("srce", "sour", "srce"), ("0\t1\n\t\t\t\t", "0\t2\n\t\t\t\t", "counts differ"), ("tb\n1000", "tb\n-1", "out of range")])
def test_malformed(old, new, what):
    text = emit(sample()).decode("utf-16-le")
    assert old in text
    with pytest.raises(Malformed, match=what):
        parse(text.replace(old, new, 1).encode("utf-16-le"))


def test_values():
    assert extents("2 10 b S 0 4") == [(16, 11, False), (0, 4, True)]
    for bad in ("1 10", "2 10 b", "S 1 2", "1 xx 2"):
        with pytest.raises(Malformed):
            extents(bad)
    with pytest.raises(Malformed, match="truncated|not"):
        parse("5\nrec\n".encode("utf-16-le"))


@pytest.mark.parametrize("format", ["L01", "Lx01"])
def test_files_in_a_container(spark, tmp_path, format):
    from sectorloom.kernels import build
    from sectorloom.operators.catalog import paths, read_files
    from sectorloom.sources.ewf import read_ewf
    from sectorloom.sources.sink import write_ewf

    data = bytes(range(256)) * 20
    rows = spark.createDataFrame([(i // 1024, data[i : i + 1024]) for i in range(0, len(data), 1024)], "chunk_index long, data binary")
    c = sample()
    c.entries[2] |= {"extents": [(1000, 60, False), (0, 4, True), (5, 3, False)], "size": 67}
    (path,) = write_ewf(rows, str(tmp_path / "x"), len(data), build.Options(format, 2, 512, catalog=c))
    entries = read_ewf(spark, path, "file_entries")
    assert entries.count() == 4 and read_ewf(spark, path, "permissions").first()["access_mask"] == 2032127
    named = {r["entry"]: r["path"] for r in paths(entries.fillna("", ["name"]), "entry_key", "parent_key", "name").collect()}
    assert named[2].split("\t")[-2:] == ["docs", "a.txt"]
    files = {r["entry_key"]: bytes(r["data"]) for r in read_files(entries, read_ewf(spark, path, "file_extents"), read_ewf(spark, path), 1024).collect()}
    assert files == {0: b"", 1: b"", 2: data[1000:1060] + bytes(4) + data[5:8], 3: b""}


def test_paths_below_64_levels(spark):
    from sectorloom.operators.catalog import paths

    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(71)] + [(100, 101, "a"), (101, 100, "b"), (200, 70, "leaf")]
    got = {r["entry"]: (r["path"], r["depth"]) for r in paths(spark.createDataFrame(rows, "k long, up long, name string").coalesce(1), "k", "up", "name", "/").collect()}
    assert got == {i: ("/".join(f"n{j}" for j in range(i + 1)), i) for i in range(71)} | {200: ("/".join(f"n{j}" for j in range(71)) + "/leaf", 71)}
    with pytest.raises(ValueError, match="cycle"):
        paths(spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, 1, "c")], "k long, up long, name string").coalesce(1), "k", "up", "name")
