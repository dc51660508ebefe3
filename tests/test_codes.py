"""Metadata codes and the operators on files, writes and lookups, against plain Python and hand-made bytes."""

import random

import pytest
from pyspark.sql import functions as F

from sectorloom.functions import codes as C
from sectorloom.operators import catalog, chunks, ranges


def one(spark, column, *values, schema="s string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r["x"] for r in rows.select(column.alias("x")).collect()]


def test_numbers(spark):
    texts = ("0", "+7", "-7", "-0", " 1", "1 ", "", "00018446744073709551615", "18446744073709551616", "9" * 30, "x", None, "1.0", "2147483648", "-2147483648")
    assert [None if x is None else int(x) for x in one(spark, C.number(F.col("s"), "u64"), *texts)] == [0, 7, None, None, None, None, None, 2**64 - 1, None, None, None, None, None, 2**31, None]
    assert one(spark, C.number(F.col("s"), "i32"), *texts) == [0, 7, -7, 0, None, None, None, None, None, None, None, None, None, None, -(2**31)]
    assert one(spark, C.number(F.col("s"), "non_negative"), "-1", "5", "2147483648") == [None, 5, None]
    assert [None if x is None else int(x) for x in one(spark, C.hex_number(F.col("s")), "ff", "FFFFFFFFFFFFFFFF", "00FFFFFFFFFFFFFFFFF", "1FFFFFFFFFFFFFFFF", "g", "-1", "")] == [255, 2**64 - 1, None, None, None, None, None]
    assert one(spark, C.hex_stream(F.col("s")), "0a 0B\n", "0", "zz", "", None) == [b"\n\x0b", None, None, b"", None]


def test_entities_in_one_pass(spark):
    texts = ("&lt;a&gt;", "a & b &lt; c", "&amp;lt;", "&x;&apos;", "tail &", "", None, "&amp", ";&quot;;")
    assert one(spark, C.entities_decoded(F.col("s")), *texts) == ["<a>", "a & b &lt; c", "&lt;", "&x;'", "tail &", "", None, "&amp", ';";']


def test_code_pages(spark):
    for page, text, data in (("windows-1252", "é€\x81", b"\xe9\x80\x81"), ("windows-1251", "Привет", "Привет".encode("cp1251")), ("windows-932", "日本", "日本".encode("cp932")), ("windows-936", "中文", "中文".encode("gbk")), ("ascii", "é", "é".encode()), ("windows-874", "ไทย", "ไทย".encode("cp874"))):
        assert one(spark, C.page_encoded(F.col("s"), page), text) == [data]
        assert one(spark, C.page_decoded(F.col("s"), page), data, schema="s binary") == [text]
    assert one(spark, C.page_encoded(F.col("s"), "windows-1252"), "日") == [b"&#26085;"]
    assert one(spark, C.page_decoded(F.col("s"), "windows-1253"), b"\xaa", None, schema="s binary") == ["�", None]


def test_attributes(spark):
    # written by hand: a branch called Attributes, another branch, then two records
    lead = bytes.fromhex("00000000010b00000001000000") + "Attributes\0".encode("utf-16-le") + bytes(2)
    branch = bytes.fromhex("00000000010200000000000000") + "b\0".encode("utf-16-le")
    first = bytes.fromhex("00000000000300000004000000") + "ab\0".encode("utf-16-le") + "xyz\0".encode("utf-16-le")
    second = bytes.fromhex("00000000000000000001000000") + bytes(2)
    text = (lead + branch + first + second).hex().upper()
    got = one(spark, C.attributes_parsed(F.col("s")), text, "", (lead + first)[:-3].hex(), "0011", None, text[:40] + " \n" + text[40:])
    want = [("ab", "xyz"), (None, None)]
    plain = [None if g is None else [(a["name"], a["value"]) for a in g] for g in got]
    assert plain == [want, [], None, None, None, want]
    rows = spark.createDataFrame([([("ab", "xyz"), (None, "")],), ([],), (None,)], "a array<struct<name:string,value:string>>")
    assert [r["x"] for r in rows.select(C.attributes_text(F.col("a")).alias("x")).collect()][1:] == ["", None]
    back = rows.select(C.attributes_parsed(C.attributes_text(F.col("a"))).alias("x")).first()["x"]
    assert [(a["name"], a["value"]) for a in back] == [("ab", "xyz"), (None, None)]


def test_paths_and_pairs(spark):
    assert one(spark, C.path_normalised(F.col("s"), "/h/i"), "a/./b/../c", "/../..", "/x//y/", "..", "") == ["/h/i/a/c", "/", "/x/y", "/h", "/h/i"]
    assert [None if x is None else (int(x["first"]), int(x["second"])) for x in one(spark, C.number_pair(F.col("s")), "1\t2", "1", "1\t2\t3", "1\tx")] == [(1, 2), None, None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlay(spark, seed):
    rng = random.Random(seed)
    want, rows = {}, []
    for k in ("a", "b", "c"):
        laid = bytearray()
        for seq in range(12):
            at, data = rng.randrange(0, 90), bytes([seq + 1]) * rng.choice([0, 1, 5, 30])
            rows.append((k, at, seq, data))
            if data:
                laid.extend(bytes(max(0, at + len(data) - len(laid))))
                laid[at : at + len(data)] = data
        want[k] = bytes(laid)
    rows.append(("none", 5, 0, b""))
    got = chunks.overlay(spark.createDataFrame(rows, "k string, offset long, seq int, data binary"), "k", 16).orderBy("k", "chunk_index").collect()
    joined = {}
    for r in got:
        assert len(joined.get(r["k"], b"")) == r["chunk_index"] * 16
        joined[r["k"]] = joined.get(r["k"], b"") + bytes(r["data"])
    assert joined == want


def test_file_parts(spark):
    data = bytes(range(200))
    held = spark.createDataFrame([("i", i // 32, data[i : i + 32]) for i in range(0, 200, 32)], "image string, chunk_index long, data binary")
    extents = [("i", 1, 0, 150, 40, False), ("i", 1, 1, 0, 70, True), ("i", 1, 2, 3, 10, False), ("i", 2, 0, 190, 50, False)]
    whole = data[150:190] + bytes(70) + data[3:13]
    entries = [("i", 1, 118, -1), ("i", 2, 50, None), ("i", 3, 20, 60), ("i", 4, 0, None)]
    e = spark.createDataFrame(entries, "image string, entry long, logical_size long, duplicate_data_offset long")
    x = spark.createDataFrame(extents, "image string, entry long, extent_ordinal int, data_offset long, data_size long, sparse boolean")
    for offset, length in ((0, None), (5, 60), (39, 2), (117, 50), (500, 5)):
        parts = catalog.file_parts(e, x, held, 32, ["image", "entry"], ["image"], offset, length)
        read = {k: b"" for k in (1, 2, 3, 4)}
        for r in parts.orderBy("entry", "position").collect():
            assert r["position"] == offset + len(read[r["entry"]])
            read[r["entry"]] += bytes(r["data"])
        stop = None if length is None else offset + length
        assert read == {1: whole[:118][offset:stop], 2: data[190:200][offset:stop], 3: data[60:80][offset:stop], 4: b""}
        short = {r["entry"] for r in catalog.uncovered(e, parts, ["image", "entry"], offset, length).collect()}
        assert short == ({2} if offset < 50 and (stop is None or stop > 10) else set())


def test_lookups(spark):
    entries = [("r", None, "root", 0), ("a", "r", "x", 1), ("b", "r", "x", 0), ("c", "a", "y", 0), ("d", "b", "z", 0)]
    tree = spark.createDataFrame(entries, "k string, up string, name string, n int")
    asked = spark.createDataFrame([(p,) for p in ("", "\t", "x", "\tx", "x\t", "x\tz", "x\0z", "x\ty", "x\t\tz", "q")], "path string")
    got = {r["path"]: r["entry"] for r in catalog.entry_by_path(tree, asked, "k", "up", "name", "n").collect()}
    assert got == {"": "r", "\t": "r", "x": "b", "\tx": "b", "x\t": "b", "x\tz": "d", "x\0z": "d", "x\ty": None, "x\t\tz": None, "q": None}
    held = spark.createDataFrame([(0, 5, 1), (5, 9, 2), (20, 19, 3), (7, 3000, 4)], "a long, b long, o int")
    points = spark.createDataFrame([(p,) for p in (0, 5, 6, 9, 10, 3000, 3001, None)], "p long")
    assert {r["p"]: r["o"] for r in ranges.containing(points, held, "p", "a", "b", "o").collect()} == {0: 1, 5: 1, 6: 2, 9: 2, 10: 4, 3000: 4, 3001: None, None: None}


def test_packing_is_a_stream(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 60) for _ in range(3000)]
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate(sizes)], "k string, i long, n long")
    used, segment, want = 0, 1, []
    for n in sizes:
        if used and used + n > 100:
            used, segment = 0, segment + 1
        used += n
        want.append(segment)
    assert [r["segment"] for r in chunks.pack(rows, "k", ["i"], "n", 100).orderBy("i").collect()] == want
