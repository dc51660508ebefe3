"""Containers written and read back, in all formats; damage is found."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sectorloom.kernels import build
from sectorloom.kernels.codec import Malformed, decode, encode, repeated_pattern
from sectorloom.sources.ewf import discover, probe, read_ewf, verify
from sectorloom.sources.sink import write_ewf

CHUNK = 8 * 512


def payload(n: int) -> bytes:
    rng = random.Random(3)
    parts = [bytes(CHUNK), b"pattern!" * (CHUNK // 8), rng.randbytes(CHUNK)]
    out = b"".join(rng.choice(parts) if rng.random() < 0.5 else bytes(rng.choices(b"abc", k=CHUNK)) for _ in range(-(-n // CHUNK)))
    return out[:n]


def chunk_rows(spark, data: bytes):
    rows = [(i // CHUNK, data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)]
    return spark.createDataFrame(rows, "chunk_index long, data binary")


@pytest.mark.parametrize(("format", "method"), [("E01", "zlib"), ("E01", "none"), ("L01", "zlib"), ("S01", "zlib"), ("Ex01", "zlib"), ("Ex01", "bzip2"), ("Lx01", "none")])
@pytest.mark.parametrize("split", [None, 30_000])
def test_round_trip(spark, tmp_path, format, method, split):
    data = payload(40 * CHUNK + 700)
    options = build.Options(format, 8, 512, method, headers={"case_number": "c-1", "description": "tab\there"})
    paths = write_ewf(chunk_rows(spark, data), str(tmp_path / "image"), len(data), options, segment_size=split)
    assert len(paths) > 1 if split else len(paths) == 1
    whole = data.ljust(-(-len(data) // 512) * 512, b"\0")
    rows = read_ewf(spark, paths[0], "chunks").orderBy("chunk_index").collect()
    assert b"".join(r["data"] for r in rows) == whole
    image = read_ewf(spark, paths[0], "images").first()
    assert (image["logical_size"], image["chunk_count"], image["segment_count"]) == (len(whole), len(rows), len(paths))
    (found,) = verify(spark, paths[0]).collect()
    assert found["md5"] == hashlib.md5(whole).hexdigest()
    assert found["md5_match"] and found["sha1_match"]
    headers = {r["identifier"]: r["value"] for r in read_ewf(spark, paths[0], "header_values").collect()}
    assert headers["case_number"] == "c-1"
    kinds = {r["encoding"] for r in read_ewf(spark, paths[0], "encoded_chunks").select("encoding").collect()}
    assert ("pattern" in kinds) == options.second


def test_damage_is_found(spark, tmp_path):
    data = payload(6 * CHUNK)
    (path,) = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), build.Options("E01", 8, 512, "none"))
    whole = bytearray(open(path, "rb").read())
    row = read_ewf(spark, path, "table_ranges").first()
    whole[row["data_end"] - 10] ^= 255  # in the last chunk's data
    (tmp_path / "b.E01").write_bytes(whole)
    with pytest.raises(Exception, match="checksum"):
        read_ewf(spark, str(tmp_path / "b.E01"), "chunks").select(F.sum(F.length("data"))).collect()
    kept = read_ewf(spark, str(tmp_path / "b.E01"), "chunks", zeroOnError="true").orderBy("chunk_index").collect()
    assert [r["corrupted"] for r in kept] == [False] * 5 + [True]
    assert kept[-1]["data"] == bytes(CHUNK)
    whole[20] ^= 1  # in the first descriptor
    (tmp_path / "c.E01").write_bytes(whole)
    (tmp_path / "d.txt").write_bytes(b"not an image")
    got = {r["path"].rsplit("/", 1)[1]: (r["is_container"], r["corrupted"]) for r in probe(spark, str(tmp_path)).collect()}
    assert got == {"a.E01": (True, False), "b.E01": (True, False), "c.E01": (True, True), "d.txt": (False, False)}


def test_resume_and_stale_segments(spark, tmp_path):
    data = payload(20 * CHUNK)
    stem, o = str(tmp_path / "r"), build.Options("E01", 8, 512)
    first = write_ewf(chunk_rows(spark, data[: 12 * CHUNK]), stem, 12 * CHUNK, o, segment_size=16_000, terminal=False)
    assert not read_ewf(spark, first[0], "images").first()["acquisition_complete"]
    kept = read_ewf(spark, first[0], "chunks").select("chunk_index", "data").cache()
    kept.count()
    more = chunk_rows(spark, data).where("chunk_index >= 12")
    again = write_ewf(kept.union(more), stem, len(data), o, mirror=str(tmp_path / "copy"))
    assert len(again) == 1 and discover(again[0]) == [again]
    assert b"".join(r["data"] for r in read_ewf(spark, again[0]).orderBy("chunk_index").collect()) == data
    assert open(again[0], "rb").read() == (tmp_path / "copy.E01").read_bytes()


def test_codecs():
    for data in (b"", b"a", bytes(10), b"abcdefgh" * 3 + b"abc", bytes(range(256)) * 4):
        for method in ("none", "zlib", "bzip2"):
            kind, stored, word = encode(data, 1024, method, patterns=True) if data else ("raw", b"\1\0\0\0", None)
            assert decode(kind, stored, len(data), word, kind == "raw") == data
    assert repeated_pattern(b"abc") == int.from_bytes(b"abc\0\0\0\0\0", "little")
    assert repeated_pattern(b"abcdefghabcdefgx") is None
    with pytest.raises(Malformed, match="checksum"):
        decode("raw", b"abcd\0\0\0\0", 4, None, True)


def test_segment_names():
    names = [build.segment_name("x", "E01", n) for n in (1, 99, 100, 101, 775, 776)]
    assert names == ["x.E01", "x.E99", "x.EAA", "x.EAB", "x.EZZ", "x.FAA"]
    assert build.segment_name("x", "Ex01", 100) == "x.ExAA"
    assert build.segment_name("x", "Lx01", 776) == "x.LyAA"
    with pytest.raises(ValueError):
        build.segment_name("x", "E01", 99 + 676 * 22 + 1)


def summed(d: bytes) -> bytes:
    return d + struct.pack("<I", zlib.adler32(d))


def with_sections(path: str, sections: list[tuple[int, str, bytes]], second: bool) -> None:
    """Puts sections before the last one of a segment."""
    whole = open(path, "rb").read()
    size = 64 if second else 76
    out, last = whole[:-size], whole[-size:]
    previous = struct.unpack_from("<Q", last, 8)[0]
    for code, kind, data in sections:
        if second:
            out += data
            d = struct.pack("<IIQQII16s", code, 0, previous, len(data), 64, 0, bytes(16)) + bytes(12)
            previous, out = len(out), out + summed(d[:60])
        else:
            out += summed(kind.encode().ljust(16, b"\0") + struct.pack("<QQ", len(out) + 76 + len(data), 76 + len(data)) + bytes(40)) + data
    if second:
        out += summed(last[:8] + struct.pack("<Q", previous) + last[16:60])
    else:
        out += summed(last[:16] + struct.pack("<QQ", len(out), 76) + bytes(40))
    open(path, "wb").write(out)


@pytest.mark.parametrize("format", ["E01", "Ex01"])
def test_sessions_tracks_and_memory(spark, tmp_path, format):
    data = bytes(64 * 512)
    (path,) = write_ewf(chunk_rows(spark, data), str(tmp_path / "a"), len(data), build.Options(format, 8, 512))
    second = format == "Ex01"
    entries = [(0, 0), (0, 1), (4, 0), (4, 1)]
    rows = b"".join(struct.pack("<QI20x", s, f) if second else struct.pack("<II24x", f, s) for s, f in entries)
    if second:
        table = summed(struct.pack("<I12x", 4)) + bytes(12) + summed(rows) + bytes(12)
        error = summed(struct.pack("<I12x", 1)) + bytes(12) + summed(struct.pack("<QII", 9, 2, 0)) + bytes(12)
        memory = struct.pack("<4Q", 0x1000, 7, 0x2000, 11)
        with_sections(path, [(0x06, "", table), (0x0C, "", memory), (0x05, "", error)], True)
    else:
        with_sections(path, [(0, "session", summed(struct.pack("<I28x", 4)) + summed(rows))], False)
    got = lambda t: [tuple(r)[1:] for r in read_ewf(spark, path, t).orderBy("ordinal").collect()]
    assert got("sessions") == got("tracks") == [(0, 0, 4), (1, 4, 60)]
    assert got("memory_extents") == ([(0, 0x1000, 7), (1, 0x2000, 11)] if second else [])
    assert got("acquisition_errors") == ([(0, 9, 2)] if second else [])


def test_session_rules():
    from sectorloom.kernels.layout import session_ranges

    assert session_ranges([], 64) == ([], [])
    assert session_ranges([(5, 1)], 64) == ([(0, 64)], [])
    assert session_ranges([(0, 0), (32, 0)], 64) == ([(0, 32), (32, 32)], [])
    with pytest.raises(Malformed, match="backwards"):
        session_ranges([(4, 0), (3, 0)], 64)
