"""Writing containers: chunks are encoded where they are, segments are packed by size, one task builds each.

The packing looks at (chunk, stored size) alone; payloads move once, to their segment's task, which
passes them on chunk by chunk. Files go to a path that all executors share, under temporary names until
every segment is whole, so that a set may be written anew from its own chunks. The hashes need the chunks
in order: one task reads a set's segments one after the other and puts the hashes into the last.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorloom.kernels import build
from sectorloom.kernels.codec import Malformed, decode, encode
from sectorloom.operators.chunks import overlay, pack, stream_hashes
from sectorloom.sources.ewf import Image, _reader, discover, file_rows, opened, read_ewf, slices

#: Stored bytes of the segments that a task writes, if they are smaller; tasks at least, if there are as many segments.
WRITE_BYTES, WRITE_TASKS = 32 << 20, 64
#: Stand for the hashes until the segments are written.
UNKNOWN = ("0" * 32, "0" * 40)
ENCODED = "chunk_index long, encoding string, stored binary, pattern binary"


def folder(spark: SparkSession) -> str:
    """A new folder for segments in the one that spark.checkpoint.dir names, or a temporary one where it is unset; driver and executors must mount it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    path = os.path.join(re.sub("^file:/+", "/", found), f"sectorloom-{uuid.uuid4().hex}") if found else tempfile.mkdtemp(prefix="sectorloom-")
    os.makedirs(path, exist_ok=True)
    return path


def _wanted(i: int, options: build.Options, size: int) -> int:
    """Bytes of chunk i: the last is padded to whole sectors."""
    last = (size - 1) // options.chunk_size
    return options.chunk_size if i < last else -(-(size - last * options.chunk_size) // options.bytes_per_sector) * options.bytes_per_sector


def _encoded(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["chunk_index", "encoding", "stored", "pattern"])


def _stored(i: int, data: bytes, options: build.Options, size: int) -> tuple:
    want = _wanted(i, options, size)
    if len(data) > want:
        raise ValueError(f"chunk {i} holds {len(data)} bytes, {want} at most")
    kind, stored, word = encode(data.ljust(want, b"\0"), options.chunk_size, options.method, options.level, patterns=options.second)
    return i, kind, stored, None if word is None else word.to_bytes(8, "little")


def encode_chunks(chunks: DataFrame, options: build.Options, size: int) -> DataFrame:
    """(chunk_index, data) -> (chunk_index, encoding, stored, pattern); the last chunk is padded to whole sectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _encoded([_stored(i, data, options, size) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    return chunks.select("chunk_index", "data").mapInArrow(run, ENCODED)


def passed_chunks(encoded: DataFrame, options: build.Options, size: int, chunk_size: int) -> DataFrame:
    """An image's ``encoded_chunks`` as stored, each if it is whole, of this chunk size and in an encoding that the options write; else encoded anew."""
    own = {"raw"} | ({"pattern"} if options.second else set()) | ({options.method} if options.method != "none" else set())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, n, kind, word, checked, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = decode(kind, data, n, None if word is None else int(word), checked)
                if kind in own and chunk_size == options.chunk_size and n == _wanted(i, options, size) and (kind != "raw" or checked and len(data) == n + 4):
                    rows.append((i, kind, data, int(word).to_bytes(8, "little") if isinstance(word, Decimal) else None))
                else:
                    rows.append(_stored(i, whole, options, size))
            yield _encoded(rows)

    return encoded.select("chunk_index", "logical_size", "encoding", "pattern", "has_checksum", "data").mapInArrow(run, ENCODED)


def write_ewf(chunks: DataFrame, stem: str, size: int, options: build.Options | None = None, segment_size: int | None = None, terminal: bool = True, mirror: str | None = None, stored: DataFrame | None = None) -> list[str]:
    """Writes chunks (chunk_index, data) of a stream of ``size`` bytes as ``stem``.E01 and so on; returns the paths.

    ``chunk_index`` runs from 0 without gaps. ``segment_size`` splits greedily by a segment's whole size; a
    segment takes one chunk at least. Without ``terminal`` the set ends by "next", so that it can be resumed by
    writing its chunks and more again. ``mirror``: the stem of a second, equal copy elsewhere. Hashes of the
    padded stream are stored. ``stored``: the chunks as they are to be stored, if they are already encoded.
    """
    ((_, paths),) = _write(chunks, stem, size, options or build.Options(), segment_size, terminal, mirror, stored, False)
    return paths


def write_ewf_sets(chunks: DataFrame, stem: str, size: int, options: build.Options | None = None, segment_size: int | None = None) -> list[tuple[int, list[str]]]:
    """As write_ewf, also where the stream makes more segments than a set has names for: its parts go to sets ``stem``, ``stem``-2 and so on.

    Returns (first chunk, paths) of each set. A set is whole, counts its chunks from 0 and has its own part's hashes.
    """
    return _write(chunks, stem, size, options or build.Options(), segment_size, True, None, None, True)


def _set_stem(stem: str, part: int) -> str:
    return f"{stem}-{part + 1}" if part else stem


def _write(chunks: DataFrame, stem: str, size: int, options: build.Options, segment_size: int | None, terminal: bool, mirror: str | None, stored: DataFrame | None, sets: bool) -> list[tuple[int, list[str]]]:
    if mirror is not None and os.path.normpath(os.path.abspath(mirror)) == os.path.normpath(os.path.abspath(stem)):
        raise ValueError("the copy must lie elsewhere")
    options.check_ranges(-(-size // options.bytes_per_sector))
    token = uuid.uuid4().hex
    held, firsts, n_bytes = _packed(chunks, stored, size, options, segment_size)
    try:
        if not len(firsts):
            raise ValueError("no chunks were given")
        parts = -(-len(firsts) // build.most_segments(options.format))
        if parts > 1 and not sets:
            raise ValueError(f"too many segments: {len(firsts)}, and {options.format} names {build.most_segments(options.format)}")
        if parts > 1 and (options.errors or options.sessions or options.tracks or options.catalog):
            raise ValueError("ranges and a catalog are of one set")
        each = -(-len(firsts) // parts)
        _segments(held, firsts, n_bytes, each, size, options, terminal, UNKNOWN if terminal else None, lambda *a: _to_files(stem, mirror, token, *a)).select("segment").collect()
    finally:
        held.unpersist()
    begins = range(0, len(firsts), each)
    counts = [min(each, len(firsts) - b) for b in begins]
    stems = list(filter(None, (stem, mirror)))
    if terminal:
        chunks.sparkSession.range(0, len(counts), 1, len(counts)).mapInArrow(_hashed(stems, token, options, counts), "part long").collect()
    out = []
    for part, (begin, count) in enumerate(zip(begins, counts, strict=True)):
        for at in stems:
            paths = [build.segment_name(_set_stem(at, part), options.format, i + 1) for i in range(count)]
            for path in paths:
                os.replace(f"{path}.{token}", path)
            if at == stem:
                out.append((int(firsts[begin]), paths))
            remove_stale(_set_stem(at, part), options.format, count)
    return out


def segments_ewf(chunks: DataFrame, size: int, options: build.Options | None = None, segment_size: int | None = None, stem: str = "image") -> DataFrame:
    """(segment, path, content): the segments as rows instead of files, for a sink of the caller's own; each must fit a value."""
    options = options or build.Options()
    options.check_ranges(-(-size // options.bytes_per_sector))
    held, firsts, n_bytes = _packed(chunks, None, size, options, segment_size)
    if len(firsts) > build.most_segments(options.format):
        held.unpersist()
        raise ValueError(f"too many segments: {len(firsts)}, and {options.format} names {build.most_segments(options.format)}")
    hashes = _padded_hashes(chunks, options, size, -(-size // options.bytes_per_sector) * options.bytes_per_sector)
    return _segments(held, firsts, n_bytes, len(firsts), size, options, True, hashes, lambda *a: _to_rows(stem, *a))


def _packed(chunks: DataFrame, stored: DataFrame | None, size: int, options: build.Options, segment_size: int | None) -> tuple[DataFrame, np.ndarray, int]:
    """The stored chunks, kept; the first chunk of each segment; the stored bytes."""
    padded = -(-size // options.bytes_per_sector) * options.bytes_per_sector
    n = -(-size // options.chunk_size)
    stored = (encode_chunks(chunks, options, size) if stored is None else stored).persist()
    try:
        found = stored.agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"), F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.sum(F.octet_length("stored")).alias("bytes")).first()
        if (found["n"], found["d"]) != (n, n) or n and (found["lo"], found["hi"]) != (0, n - 1):
            raise ValueError(f"{found['n']} chunks can't hold {size} bytes")
        firsts = [0] * (n > 0)
        if segment_size:
            sizes = stored.select(F.lit(0).alias("k"), "chunk_index", F.octet_length("stored").cast("long").alias("size"))
            group = (1 << 62, 1 << 62) if options.second else (build.GROUP_ENTRIES, build.GROUP_BYTES)
            packed = pack(sizes, "k", ["chunk_index"], "size", segment_size, build.segment_cost(options, padded, n), group)
            firsts = sorted(r[0] for r in packed.groupBy("segment").agg(F.min("chunk_index").alias("first")).select("first").collect())
    except Exception:
        stored.unpersist()
        raise
    return stored, np.array(firsts, dtype=np.int64), found["bytes"] or 0


def _segments(stored: DataFrame, firsts: np.ndarray, n_bytes: int, each: int, size: int, options: build.Options, terminal: bool, hashes: tuple[str, str] | None, sink) -> DataFrame:
    """(segment, path, content) of the segments that begin at ``firsts``, ``each`` of them to a set; a task writes neighbours."""
    tasks = max(1, min(len(firsts), max(WRITE_TASKS, n_bytes // WRITE_BYTES)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segment = np.searchsorted(firsts, b.column(0).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(firsts[segment]), pa.array((segment * tasks // len(firsts)).astype(np.int32)), *b.columns], names=["segment", "first", "task", *b.schema.names])

    rows = stored.mapInArrow(place, f"segment long, first long, task int, {ENCODED}").repartitionById(tasks, "task").sortWithinPartitions("chunk_index")
    rows = rows.select("segment", "first", "chunk_index", "encoding", "stored", "pattern")
    return rows.mapInArrow(_writer(options, firsts[::each].tolist(), each, len(firsts), size, terminal, hashes, sink), "segment long, path string, content binary")


def copy_ewf(spark: SparkSession, path: str | list[str], stem: str, segment_size: int | None = None, mirror: str | None = None, **changes) -> list[str]:
    """Writes an image anew with its media, headers, ranges and catalog, and the given options changed; stored hashes are computed, not copied.

    Chunks that the new container can hold as they are stored aren't encoded again.
    """
    image = read_ewf(spark, path, "images").first()
    listed = lambda table, *columns: tuple(tuple(r) for r in read_ewf(spark, path, table).orderBy("ordinal").select(*columns).collect())
    known = {
        "format": "S01" if image["profile"] == "smart" else image["format"], "sectors_per_chunk": image["sectors_per_chunk"], "bytes_per_sector": image["bytes_per_sector"], "method": image["compression_method"],
        "headers": {r["identifier"]: r["value"] for r in read_ewf(spark, path, "header_values").collect()}, "media_type": image["media_type"], "fastbloc": image["fastbloc"], "tableau": image["tableau"], "error_granularity": image["error_granularity"] or 0,
        "errors": listed("acquisition_errors", "first_sector", "sector_count"), "sessions": listed("sessions", "first_sector", "sector_count"), "tracks": listed("tracks", "first_sector", "sector_count"), "memory_extents": listed("memory_extents", "start_page", "page_count"),
    }
    if image["set_identifier"]:
        known["set_identifier"] = bytes(image["set_identifier"])
    options = replace(build.Options(), **known | {"catalog": read_catalog(path)} | changes)
    size = image["logical_size"]
    if options.chunk_size != image["chunk_size"]:
        whole = read_ewf(spark, path, "chunks").select(F.lit(0).alias("k"), F.col("logical_offset").alias("offset"), F.lit(0).alias("seq"), "data")
        return write_ewf(overlay(whole, "k", options.chunk_size), stem, size, options, segment_size, mirror=mirror)
    stored = passed_chunks(read_ewf(spark, path, "encoded_chunks"), options, size, image["chunk_size"])
    return write_ewf(read_ewf(spark, path, "chunks"), stem, size, options, segment_size, mirror=mirror, stored=stored)


def read_catalog(path: str | list[str]):
    """The catalog of an image as the builder takes it, or none."""
    return Image(opened(path if isinstance(path, list) else discover(path)[0]), "").catalog


def resume_ewf(spark: SparkSession, path: str, writes: DataFrame, size: int, options: build.Options, segment_size: int | None = None) -> list[str]:
    """Continues a set that ends by "next": its chunks, laid over by writes (offset, seq, data), are written whole under the same stem."""
    image = read_ewf(spark, path, "images").first()
    if image["acquisition_complete"]:
        raise ValueError("the set is complete")
    kept = read_ewf(spark, path, "chunks").select(F.lit(0).alias("k"), F.col("logical_offset").alias("offset"), F.lit(-1).cast("long").alias("seq"), "data")
    more = writes.select(F.lit(0).alias("k"), F.col("offset").cast("long"), F.col("seq").cast("long"), "data")
    return write_ewf(overlay(kept.union(more), "k", options.chunk_size), os.path.splitext(path)[0], size, options, segment_size)


def _padded_hashes(chunks: DataFrame, options: build.Options, size: int, padded: int) -> tuple[str, str]:
    last = (size - 1) // options.chunk_size
    fill = F.unhex(F.repeat(F.lit("00"), padded - size))
    data = F.when(F.col("chunk_index") == last, F.concat("data", fill)).otherwise(F.col("data")) if padded > size else F.col("data")
    row = stream_hashes(chunks.select(F.lit(0).alias("k"), "chunk_index", data.alias("data")), "k").first()
    return row["md5"], row["sha1"]


def _hashed(stems: list[str], token: str, options: build.Options, counts: list[int]):
    """Hashes a set's temporary files in order, and puts the hashes where the last one and its copy hold their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                paths = [build.segment_name(_set_stem(stems[0], part), options.format, i + 1) for i in range(counts[part])]
                image = Image([(p, _reader(f"{p}.{token}"), os.path.getsize(f"{p}.{token}")) for p in paths], "")
                md5, sha1 = hashlib.md5(), hashlib.sha1()
                for x in slices(image):
                    for row in file_rows(x, f"{x.path}.{token}", "chunks", False):
                        md5.update(row[-1])
                        sha1.update(row[-1])
                hashes = (md5.hexdigest(), sha1.hexdigest())
                known = dict(build.tail2(options, hashes) if options.second else build.tail1(options, hashes))
                for stem in stems:
                    with open(f"{build.segment_name(_set_stem(stem, part), options.format, counts[part])}.{token}", "r+b") as f:
                        for x in image.segments[-1].sections:
                            if x.kind in ("digest", "md5_hash", "sha1_hash"):
                                f.seek(x.data_offset)
                                f.write(known[x.kind])
            yield b

    return run


def _writer(options: build.Options, begins: list[int], each: int, segments: int, size: int, terminal: bool, hashes: tuple[str, str] | None, sink):
    """``begins``: the first chunk of each set, which has ``each`` segments, the last one fewer."""
    padded = -(-size // options.bytes_per_sector) * options.bytes_per_sector
    ends = [*begins[1:], -(-size // options.chunk_size)]

    def chunks_of(rows: Iterator[tuple], segment: int, held: list) -> Iterator[build.Stored]:
        for r in rows:
            if r[0] != segment:
                held.append(r)
                return
            yield r[3], r[4], int.from_bytes(r[5], "little") if r[5] else (0 if r[3] == "pattern" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        head = next(rows, None)
        while head is not None:
            segment, first, held = head[0], head[1], []
            own = chunks_of(itertools.chain([head], rows), segment, held)
            part, number = divmod(segment, each)
            last = segment + 1 in (segments, (part + 1) * each) and terminal
            count, begin = ends[part] - begins[part], begins[part]
            own_size = min(padded - begin * options.chunk_size, count * options.chunk_size)

            def put(f, number=number + 1, first=first - begin, own=own, count=count, own_size=own_size, last=last) -> None:
                if options.second:
                    build.second_generation(options, f, number, own, first, count, own_size, last, hashes)
                else:
                    build.first_generation(options, f, number, own, count, own_size, last, hashes)

            path, content = sink(options, part, number + 1, put)
            yield pa.RecordBatch.from_arrays([pa.array([segment + 1], pa.int64()), pa.array([path]), pa.array([content], pa.binary())], names=["segment", "path", "content"])
            head = held[0] if held else None

    return run


def _to_files(stem: str, mirror: str | None, token: str, options: build.Options, part: int, segment: int, put) -> tuple[str, None]:
    """A segment under a temporary name, and its copy; an attempt's file replaces an earlier attempt's."""
    path = build.segment_name(_set_stem(stem, part), options.format, segment)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "w+b") as f:
        put(f)
    if mirror:
        copy = f"{build.segment_name(_set_stem(mirror, part), options.format, segment)}.{token}"
        with open(own, "rb") as a, open(f"{copy}.part", "wb") as b:
            while piece := a.read(1 << 20):
                b.write(piece)
        os.replace(f"{copy}.part", copy)
    os.replace(own, f"{path}.{token}")
    return path, None


def _to_rows(stem: str, options: build.Options, part: int, segment: int, put) -> tuple[str, bytes]:
    f = io.BytesIO()
    put(f)
    return build.segment_name(stem, options.format, segment), f.getvalue()


def remove_stale(stem: str, format: str, segments: int) -> None:
    """Deletes the segments that follow the last one, up to the first that is missing."""
    while segments < build.most_segments(format) and os.path.exists(path := build.segment_name(stem, format, segments + 1)):
        os.remove(path)
        segments += 1
