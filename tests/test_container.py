"""Containers beyond the round trip: metadata of all kinds, copies, resumed sets, supplied bytes, and hand-made layouts."""

import hashlib
import os
import random
import struct
import zlib

import pytest

from sectorloom.kernels import build, layout
from sectorloom.kernels.codec import Malformed
from sectorloom.sources import ewf
from sectorloom.sources.ewf import probe_sets, raw_export, read_ewf, read_ewf_bytes, verify
from sectorloom.sources import sink
from sectorloom.sources.sink import copy_ewf, resume_ewf, segments_ewf, write_ewf

CHUNK = 8 * 512


def chunk_rows(spark, data: bytes):
    return spark.createDataFrame([(i // CHUNK, data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)], "chunk_index long, data binary")


def media(spark, path, **options):
    return b"".join(bytes(r["data"]) for r in read_ewf(spark, path, **options).orderBy("chunk_index").collect())


def ordinals(spark, path, table):
    return [tuple(r)[2:] for r in read_ewf(spark, path, table).orderBy("ordinal").collect()]


def payload(n: int) -> bytes:
    rng = random.Random(9)
    return b"".join(rng.choice([bytes(CHUNK), b"pattern!" * (CHUNK // 8), rng.randbytes(CHUNK), bytes(rng.choices(b"ab", k=CHUNK))]) for _ in range(-(-n // CHUNK)))[:n]


def full(format: str, sectors: int) -> build.Options:
    more = {} if format[1] != "x" else {"memory_extents": ((1, 2), (5, 9)), "aux_numbers": (7, 1 << 63), "aux_digests": ("ab" * 16,), "increments": (b"one", b"two"), "analytical": "anä", "restart": "r", "final": b"f"}
    headers = {"case_number": "c", "notes": "a\tb"} | ({"extent": "<x>&"} if format == "E01" else {})
    hashes = {"SHA256": "cd" * 32} if format == "E01" else {"MD5": "0f" * 16}
    half = sectors // 2
    return build.Options(format, 8, 512, headers=headers, media_type="optical", fastbloc=True, error_granularity=4, errors=((3, 2), (9, 1)), sessions=((0, half), (half, sectors - half)), hashes=hashes, **more)


@pytest.mark.parametrize("format", ["E01", "Ex01"])
def test_metadata_comes_back(spark, tmp_path, format):
    data = payload(20 * CHUNK)
    sectors = len(data) // 512
    o = full(format, sectors)
    (path,) = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), o)
    image = read_ewf(spark, path, "images").first()
    assert (image["media_type"], image["fastbloc"], image["tableau"], image["error_granularity"], image["physical"]) == ("optical", True, False, 4, True)
    assert image["segment_set_size"] == os.path.getsize(path)
    assert ordinals(spark, path, "acquisition_errors") == list(o.errors) and ordinals(spark, path, "sessions") == list(o.sessions)
    assert ordinals(spark, path, "memory_extents") == list(o.memory_extents)
    headers = {r["identifier"]: r["value"] for r in read_ewf(spark, path, "header_values").collect()}
    assert headers.items() >= {"case_number": "c", "notes": "a b"}.items() and (format != "E01" or headers["extent"] == "<x>&")
    stored = {r["identifier"]: r["value"] for r in read_ewf(spark, path, "hash_values").collect()}
    assert stored == ({"MD5": hashlib.md5(data).hexdigest(), "SHA1": hashlib.sha1(data).hexdigest(), "SHA256": "cd" * 32} if format == "E01" else {"MD5": "0f" * 16, "SHA1": hashlib.sha1(data).hexdigest()})
    (found,) = verify(spark, path).collect()
    assert found["md5_match"] == (format == "E01") and found["sha1_match"]
    aux = [(r["aux_table"], r["ordinal"], r["number"] and int(r["number"]), r["digest"]) for r in read_ewf(spark, path, "aux_entries").collect()]
    assert sorted(aux, key=str) == ([] if format == "E01" else sorted([("single_files_table", 0, 7, None), ("single_files_table", 1, 1 << 63, None), ("single_files_md5_hash_table", 0, None, "ab" * 16)], key=str))


def test_options_are_checked(spark, tmp_path):
    rows = chunk_rows(spark, bytes(CHUNK))
    for bad in ({"errors": ((0, 0),)}, {"errors": ((5, 1), (4, 1))}, {"errors": ((7, 2),)}, {"sessions": ((0, 3), (4, 4))}, {"sessions": ((0, 7),)}):
        with pytest.raises(ValueError):
            write_ewf(rows, str(tmp_path / "a"), CHUNK, build.Options("E01", 8, 512, **bad))
    for bad in ({"memory_extents": ((0, 1),)}, {"final": b""}, {"restart": "x"}):
        with pytest.raises(ValueError):
            if bad == {"final": b""}:
                bad = {"final": b"x"}
            build.Options("E01", 8, 512, **bad)
    with pytest.raises(ValueError, match="elsewhere"):
        write_ewf(rows, str(tmp_path / "a"), CHUNK, build.Options("E01", 8, 512), mirror=str(tmp_path / "b" / ".." / "a"))


@pytest.mark.parametrize(("format", "limit"), [("E01", 20_000), ("S01", 20_000), ("Ex01", 20_000)])
def test_segments_keep_within_their_size(spark, tmp_path, format, limit):
    data = random.Random(2).randbytes(30 * CHUNK)
    paths = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), build.Options(format, 8, 512, "none"), segment_size=limit)
    sizes = [os.path.getsize(p) for p in paths]
    assert max(sizes) <= limit and min(sizes[1:-1]) > limit - CHUNK - 1600
    assert media(spark, paths) == data == media(spark, paths[0])
    content = segments_ewf(chunk_rows(spark, data), len(data), build.Options(format, 8, 512, "none"), limit, str(tmp_path / "a"))
    rows = {r["path"]: bytes(r["content"]) for r in content.collect()}
    assert rows == {p: open(p, "rb").read() for p in paths}
    supplied = spark.createDataFrame([("x", i, rows[p]) for i, p in enumerate(paths)] + [("y", i, rows[p]) for i, p in enumerate(paths)], "image_id string, segment_index int, content binary")
    got = read_ewf_bytes(supplied).orderBy("image_id", "chunk_index").collect()
    assert b"".join(bytes(r["data"]) for r in got) == data * 2
    assert {r["image_id"]: r["segment_count"] for r in read_ewf_bytes(supplied, "images").collect()} == {"x": len(paths), "y": len(paths)}


def test_many_table_groups(spark, tmp_path, monkeypatch):
    from sectorloom.kernels.build import Options, first_generation
    from sectorloom.kernels.codec import encode

    monkeypatch.setattr(build, "GROUP_ENTRIES", 5)
    rng = random.Random(1)
    data = [rng.choice([bytes(512), rng.randbytes(512)]) for _ in range(23)]
    path = tmp_path / "g.E01"
    with open(path, "w+b") as f:
        first_generation(Options("E01", 1, 512), f, 1, (encode(d, 512) for d in data), 23, 23 * 512, True, None)
    assert media(spark, str(path)) == b"".join(data)
    assert read_ewf(spark, str(path), "table_ranges").count() == 5


def test_copies(spark, tmp_path):
    data = payload(25 * CHUNK)
    o = full("E01", len(data) // 512)
    (path,) = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), o)
    (same,) = copy_ewf(spark, path, str(tmp_path / "b"), mirror=str(tmp_path / "m"))
    encoded = lambda p: [(r["encoding"], bytes(r["data"])) for r in read_ewf(spark, p, "encoded_chunks").orderBy("chunk_index").collect()]
    assert encoded(same) == encoded(path) and media(spark, same) == data
    assert ordinals(spark, same, "sessions") == list(o.sessions) and read_ewf(spark, same, "images").first()["media_type"] == "optical"
    assert open(same, "rb").read() == (tmp_path / "m.E01").read_bytes()
    (other,) = copy_ewf(spark, path, str(tmp_path / "c"), format="Ex01", method="bzip2", sectors_per_chunk=4)
    assert media(spark, other) == data and {k for k, _ in encoded(other)} <= {"bzip2", "raw", "pattern"}
    assert raw_export(spark, path, str(tmp_path / "raw")) == len(data) and (tmp_path / "raw").read_bytes() == data


def test_resume_by_writes(spark, tmp_path):
    data = payload(10 * CHUNK)
    o = build.Options("E01", 8, 512)
    first = write_ewf(chunk_rows(spark, data), str(tmp_path / "r"), len(data), o, segment_size=20_000, terminal=False)
    more = spark.createDataFrame([(CHUNK + 5, 0, b"x" * 100), (CHUNK + 50, 1, b"y" * 10), (12 * CHUNK, 2, b"z" * 512)], "offset long, seq long, data binary")
    again = resume_ewf(spark, first[0], more, 12 * CHUNK + 512, o)
    want = bytearray(data.ljust(12 * CHUNK, b"\0") + b"z" * 512)
    want[CHUNK + 5 : CHUNK + 105] = b"x" * 100
    want[CHUNK + 50 : CHUNK + 60] = b"y" * 10
    assert again == [first[0]] and media(spark, again[0]) == bytes(want)
    assert not [f for f in os.listdir(tmp_path) if f != "r.E01"]
    with pytest.raises(ValueError, match="complete"):
        resume_ewf(spark, again[0], more, 12 * CHUNK + 512, o)


def summed(d: bytes) -> bytes:
    return d + struct.pack("<I", zlib.adler32(d))


def descriptor(kind: int, size: int, previous: int = 0, padding: int = 0, flags: int = 0, digest: bytes = bytes(16)) -> bytes:
    return summed((struct.pack("<IIQQII", kind, flags, previous, size, 64, padding) + digest + bytes(12))[:60])


def text2(names, values) -> bytes:
    return b"\xff\xfe" + ("1\nmain\n" + "\t".join(names) + "\n" + "\t".join(values) + "\n\n").encode("utf-16-le")


def leading(sections) -> bytes:
    """A container whose descriptors stand before their data, written by hand: (kind, data, padding)."""
    out = b"EVF2\r\n\x81\0" + struct.pack("<BBHI", 2, 1, 1, 1) + b"\7" * 16
    for kind, data, padding in sections:
        out += descriptor(kind, len(data), padding=padding) + data + bytes(padding)
    return out


@pytest.mark.parametrize("short", [False, True])
def test_leading_descriptors(spark, tmp_path, short):
    device = text2(["b", "sc", "tb", "dt", "wb", "gr"], ["512", "2", "2", "m", "2", "9"])
    data = os.urandom(2048)
    begin = 32 + 64 + len(device) + 6 + 64
    entries = b"".join(struct.pack("<QII", begin + 1024 * i, 1024, 0) for i in range(2))
    head = summed(struct.pack("<QI4x", 0, 2))
    table = head + entries if short else head + bytes(12) + entries + struct.pack("<I", zlib.adler32(entries)) + bytes(12)
    path = tmp_path / "l.Ex01"
    path.write_bytes(leading([(1, device, 6), (3, data, 0), (4, table, 0), (0x0F, b"", 0)]))
    assert media(spark, str(path)) == data
    image = read_ewf(spark, str(path), "images").first()
    assert (image["sector_count"], image["media_type"], image["tableau"], image["fastbloc"], image["error_granularity"], image["acquisition_complete"]) == (4, "memory", True, False, 9, True)
    whole = path.read_bytes()
    for bad, message in ((whole[:-30], "not valid"), (whole[: begin - 64] + descriptor(3, 2048, padding=3000) + whole[begin:], "padding"), (whole.replace(head[:4], head[:3] + b"\1", 1) if not short else whole[:-70], None)):
        path.write_bytes(bad)
        with pytest.raises(Exception, match=message or "."):
            media(spark, str(path))


def test_tables_need_right_checksums():
    for what, header, layout_, entry in (("error", 32, "<QI", struct.pack("<QII", 1, 2, 0)), ("session", 36, "<II", struct.pack("<II24x", 0, 1))):
        at = 16 if header == 32 else 0
        body = summed(struct.pack("<I12x", 1)) + bytes(12) if header == 32 else summed(struct.pack("<I28x", 1))
        whole = body + summed(entry) + (bytes(12) if header == 32 else b"")
        size = len(entry)
        assert layout._pairs(whole, header, size, layout_, what, at) == [struct.unpack_from(layout_, entry)]
        place = at or header - 4
        for bad in (whole[:place] + b"\0\0\0\0" + whole[place + 4 :], whole[: header + size] + b"\0\0\0\0" + whole[header + size + 4 :], whole[: header + size]):
            with pytest.raises(Malformed):
                layout._pairs(bad, header, size, layout_, what, at)


def test_profiles():
    columns = lambda *names: "1\nmain\n" + "\t".join(names) + "\n" + "\t".join("7.1" if n == "av" else "x" for n in names) + "\n\n"
    plain = ["c", "n", "a", "e", "t"]
    assert layout.header_profile(columns(*plain, "av"), 1) == "linen5" and layout.header_profile(columns(*plain, "av"), 2) == "encase4"
    assert layout.header_profile(columns(*plain, "av").replace("1\n", "3\n", 1), 2) == "encase5" and layout.header_profile(columns(*plain, "md"), 2) == "encase6"
    assert layout.header_profile(columns(*plain, "x", "l"), 2) == "encase7" and layout.header_profile("1\nmain", 1) is None
    ten = [*plain, "av", "ov", "m", "u", "p"]
    assert layout.header_profile(columns(*ten, "r"), 1) == "ftk_imager"
    assert layout.header_profile(columns(*ten, "r").replace("7.1", "2.0").replace("\n", "\r\n"), 1) == "encase2"
    assert layout.set_profile([("encase2", "encase6"), ("encase2", None)]) == "encase6"
    assert layout.set_profile([("smart", "ftk_imager")]) == "ftk_imager" and layout.set_profile([("logical_encase5", "encase6")]) == "logical_encase5"
    with pytest.raises(Malformed):
        layout.set_profile([("encase2", "encase6"), ("encase2", "encase5")])


def test_probes_of_sets(spark, tmp_path):
    data = payload(12 * CHUNK)
    paths = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), build.Options("E01", 8, 512), segment_size=10_000)
    (other,) = write_ewf(chunk_rows(spark, data), str(tmp_path / "b"), len(data), build.Options("E01", 8, 512))
    whole = bytearray(open(other, "rb").read())
    whole[20] ^= 1
    open(other, "wb").write(whole)
    got = {r["image_id"]: (r["segment_count"], r["encrypted"], r["corrupted"]) for r in probe_sets(spark, str(tmp_path)).collect()}
    assert got == {"a": (len(paths), False, False), "b": (1, False, True)} and len(paths) > 1


def test_checksum_errors(spark, tmp_path):
    data = os.urandom(6 * CHUNK)
    (path,) = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), build.Options("E01", 8, 512, "none"))
    whole = bytearray(open(path, "rb").read())
    first = read_ewf(spark, path, "table_ranges").first()
    for i in (1, 4):
        whole[first["base_offset"] + i * (CHUNK + 4) + 9] ^= 255
    (tmp_path / "b.E01").write_bytes(whole)
    assert sorted((r["first_sector"], r["sector_count"]) for r in ewf.checksum_errors(spark, str(tmp_path / "b.E01")).collect()) == [(8, 8), (32, 8)]


def test_planning_holds_no_chunk_list(tmp_path):
    """Ten million chunks are planned from a sparse file: a segment's table is known by its place."""
    n = 10_000_000
    o = build.Options("E01", 1, 512)
    path = tmp_path / "big.E01"
    with open(path, "wb") as f:
        f.write(o.signature + struct.pack("<BHH", 1, 1, 0))
        for kind, data in (("volume", build.volume(o, n, n * 512)), ("table", summed(struct.pack("<I4xQ4x", n, 0)) + bytes(4 * n + 4)), ("done", b"")):
            at = f.tell()
            f.write(summed(kind.encode().ljust(16, b"\0") + struct.pack("<QQ", at if kind == "done" else at + 76 + len(data), 76 + len(data)) + bytes(40)))
            f.write(data)
    image = ewf.Image(ewf.opened([str(path)]), "big")
    parts = list(ewf.slices(image))
    assert image.chunks == n and len(parts) == -(-n // ewf.SLICE)
    assert all(p.held is parts[0].held for p in parts)


def numbered(spark, n: int):
    return spark.range(n).selectExpr("id AS chunk_index", "unhex(rpad(hex(id), 1024, '7')) AS data")


@pytest.mark.parametrize(("format", "profile"), [("E01", "encase2"), ("L01", "logical_encase5")])
def test_segments_named_by_later_letters(spark, tmp_path, format, profile):
    """A segment for each chunk, past the seventh letter: .L.. of an E01 isn't logical, .S.. of an L01 isn't SMART."""
    n = 99 + 676 * 7 + 9
    paths = write_ewf(numbered(spark, n), str(tmp_path / "a"), n * 512, build.Options(format, 1, 512), segment_size=1)
    assert len(paths) == n and paths[-1].endswith("LAI" if format == "E01" else "SAI")
    image = read_ewf(spark, paths[0], "images").first()
    assert (image["segment_count"], image["chunk_count"], image["profile"]) == (n, n, profile)
    (found,) = verify(spark, paths[0]).collect()
    assert found["size"] == n * 512 and found["md5_match"] and found["sha1_match"]


def test_more_segments_than_names(spark, tmp_path):
    """A segment for each chunk: a set ends where its names do, and the rest goes to another."""
    n = 99 + 676 * 3 + 41
    rows = numbered(spark, n)
    data = b"".join(bytes(r["data"]) for r in rows.orderBy("chunk_index").collect())
    o = build.Options("Ex01", 1, 512)
    (tmp_path / "one").mkdir()
    with pytest.raises(ValueError, match="too many segments"):
        write_ewf(rows, str(tmp_path / "one" / "a"), len(data), o, segment_size=1)
    assert not os.listdir(tmp_path / "one")
    sets = sink.write_ewf_sets(rows, str(tmp_path / "a"), len(data), o, 1)
    assert [first for first, _ in sets] == [0, n // 2] and sum(len(paths) for _, paths in sets) == n
    for (first, paths), end in zip(sets, (n // 2, n), strict=True):
        own = data[first * 512 : end * 512]
        assert media(spark, paths[0]) == own
        assert read_ewf(spark, paths[0], "images").first()["segment_count"] == end - first
        (found,) = verify(spark, paths[0]).collect()
        assert found["md5"] == hashlib.md5(own).hexdigest() and found["md5_match"] and found["sha1_match"]
    assert len(os.listdir(tmp_path)) == n + 1


def test_a_task_reads_many_small_segments(spark, tmp_path):
    data = random.Random(4).randbytes(60 * CHUNK)
    paths = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), build.Options("E01", 8, 512), segment_size=10_000)
    read = read_ewf(spark, paths[0])
    assert len(paths) == 60 // 2 and read.rdd.getNumPartitions() == 1 and media(spark, paths[0]) == data
