"""Chunked byte streams: splitting, windows, ordered hashes, codecs, writes at positions, packing into segments."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sectorloom.functions.scalar import chunk_count
from sectorloom.kernels import codec
from sectorloom.operators.ranges import locate


def split(df: DataFrame, payload: str, chunk: int) -> DataFrame:
    """A row for each chunk of the binary column: chunk_index, logical_offset, data; none for empty payloads."""
    n = chunk_count(F.octet_length(payload).cast("long"), chunk)
    rows = df.withColumn("chunk_index", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    data = F.substring(F.col(payload), (F.col("chunk_index") * chunk + 1).cast("int"), F.lit(chunk))
    return rows.withColumn("logical_offset", F.col("chunk_index") * chunk).withColumn("data", data).drop(payload)


def read_window(chunks: DataFrame, key: str, chunk: int, offset: int, length: int) -> DataFrame:
    """(key, data): ``length`` bytes from ``offset`` of each stream, short at its end; only the chunks that the window meets are read."""
    first, last = offset // chunk, (offset + max(length, 1) - 1) // chunk
    met = chunks.where(F.col("chunk_index").between(first, last))
    begin = F.greatest(F.lit(offset) - F.col("chunk_index") * chunk, F.lit(0))
    end = F.least(F.lit(offset + length) - F.col("chunk_index") * chunk, F.octet_length("data"))
    part = F.hex(F.substring(F.col("data"), (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")))
    joined = met.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_index", part.alias("h")))).alias("parts"))
    return joined.select(key, F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")).alias("data"))


def _rolling(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, md5, sha1, size = None, None, None, 0
        kind = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([size], pa.int64()), pa.array([md5.hexdigest()]), pa.array([sha1.hexdigest()])], names=[key, "size", "md5", "sha1"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if md5 is None or k != now:
                    if md5 is not None:
                        yield row()
                    now, md5, sha1, size = k, hashlib.md5(), hashlib.sha1(), 0
                md5.update(data)
                sha1.update(data)
                size += len(data)
        if md5 is not None:
            yield row()

    return run


def stream_hashes(chunks: DataFrame, key: str) -> DataFrame:
    """(key, size, md5, sha1) of each stream's chunks in order.

    The hashes depend on order and don't merge, so a stream is one task's; chunks flow through it
    without being held, and streams spread over tasks.
    """
    rows = chunks.select(key, "chunk_index", "data").repartition(key).sortWithinPartitions(key, "chunk_index")
    kind = chunks.schema[key].dataType.simpleString()
    return rows.select(key, "data").mapInArrow(_rolling(key), f"{key} {kind}, size long, md5 string, sha1 string")


def pack(sizes: DataFrame, key: str, order: list[str], size: str, limit: int, cost: Callable[[int, int, int], int] | None = None, group: tuple[int, int] = (1 << 62, 1 << 62)) -> DataFrame:
    """Greedy next-fit: adds ``segment`` from 1; a segment holds one row at least and ends before it would exceed ``limit``.

    A segment's size is the sum of its rows, or ``cost`` of their number, their sum and how many groups of
    at most (rows, bytes) they make. The reset depends on the running total, so a key's sizes pass through
    one task in order, which holds a few numbers of them; keys spread over tasks.
    """
    total = cost or (lambda rows, used, groups: used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment, rows, used, groups, own = object(), 0, 0, 0, 0, (0, 0)
        for batch in batches:
            out = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                full = own[0] >= group[0] or own[0] > 0 and own[1] + n > group[1]
                more = groups + (groups == 0 or full)
                if k != now:
                    now, segment = k, 0
                if segment == 0 or (rows if cost else used) > 0 and total(rows + 1, used + n, more) > limit:
                    segment, rows, used, groups, own = segment + 1, 1, n, 1, (1, n)
                else:
                    rows, used, groups = rows + 1, used + n, more
                    own = (1, n) if full else (own[0] + 1, own[1] + n)
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "segment"])

    rows = sizes.select(key, *order, F.col(size).cast("long").alias("size")).repartition(key).sortWithinPartitions(key, *order, "size")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("segment", LongType())]))


ENCODED = "encoding string, stored binary, pattern decimal(20,0)"


def encode(chunks: DataFrame, chunk: int, method: str = "zlib", level: int = 6, patterns: bool = False) -> DataFrame:
    """The chunks' ``data`` as stored: encoding, stored and pattern replace it; where the chunks are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("data")
            rows = [codec.encode(x, chunk, method, level, patterns) for x in b.column(at).to_pylist()]
            kinds, stored, words = ([r[i] for r in rows] for i in range(3))
            words = [None if w is None else Decimal(w) for w in words]
            made = [pa.array(kinds, pa.string()), pa.array(stored, pa.binary()), pa.array(words, pa.decimal128(20, 0))]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *made], names=[*(n for n in b.schema.names if n != "data"), "encoding", "stored", "pattern"])

    schema = chunks.drop("data").schema
    for name, kind in (x.split(" ") for x in ENCODED.split(", ")):
        schema = schema.add(name, kind)
    return chunks.mapInArrow(run, schema)


def decode(encoded: DataFrame, size: str, zero_on_error: bool = False) -> DataFrame:
    """The inverse: ``data`` of ``size`` bytes and ``corrupted``; a chunk that can't be decoded raises, or reads as zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, stored, words, sizes = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("encoding", "stored", "pattern", size))
            out, bad = [], []
            for kind, x, w, n in zip(kinds, stored, words, sizes, strict=True):
                try:
                    out.append(codec.decode(kind, x, n, None if w is None else int(w), has_checksum=kind == "raw"))
                    bad.append(False)
                except codec.Malformed:
                    if not zero_on_error:
                        raise
                    out.append(bytes(n))
                    bad.append(True)
            rest = [i for i, n in enumerate(b.schema.names) if n not in ("encoding", "stored", "pattern")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(out, pa.binary()), pa.array(bad)], names=[*(b.schema.names[i] for i in rest), "data", "corrupted"])

    schema = encoded.drop("encoding", "stored", "pattern").schema.add("data", "binary").add("corrupted", "boolean")
    return encoded.mapInArrow(run, schema)


def overlay(writes: DataFrame, key: str, chunk: int) -> DataFrame:
    """(key, offset, seq, data) -> (key, chunk_index, data): a stream written at positions; later writes (seq) win, gaps read as zeros.

    A write is cut at the chunks that it meets; a chunk is laid by one task from its own parts, and those
    between the first and the last of a stream that nothing meets are whole chunks of zeros. The last is short.
    """
    at, n = F.col("offset"), F.octet_length("data")
    met = writes.where(n > 0).withColumn("chunk_index", F.explode(F.sequence(F.floor(at / chunk), F.floor((at + n - 1) / chunk))))
    begin = F.greatest(F.col("chunk_index") * chunk - at, F.lit(0)).cast("int")
    end = F.least((F.col("chunk_index") + 1) * chunk - at, n).cast("int")
    parts = met.select(key, "chunk_index", "seq", (at + begin - F.col("chunk_index") * chunk).cast("int").alias("place"), F.substring(F.col("data"), begin + 1, end - begin).alias("data"))
    kind = writes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, laid, of = None, bytearray(), None
        for b in batches:
            keys, rows, of = [], [], b.schema.field(0).type
            for k, i, place, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, i) != now:
                    if now is not None:
                        keys.append(now)
                        rows.append(bytes(laid))
                    now, laid = (k, i), bytearray()
                if len(laid) < place + len(data):
                    laid.extend(bytes(place + len(data) - len(laid)))
                laid[place : place + len(data)] = data
            yield batch(keys, rows, of)
        if now is not None:
            yield batch([now], [bytes(laid)], of)

    def batch(keys, rows, of):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], of), pa.array([i for _, i in keys], pa.int64()), pa.array(rows, pa.binary())], names=[key, "chunk_index", "data"])

    rows = parts.repartition(key, "chunk_index").sortWithinPartitions(key, "chunk_index", "seq").select(key, "chunk_index", "place", "data")
    laid = rows.mapInArrow(run, f"{key} {kind}, chunk_index long, data binary")
    ends = writes.where(n > 0).groupBy(key).agg(F.max(at + n).alias("size"))
    every = ends.select(key, "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk))).alias("chunk_index"))
    size = F.least(F.lit(chunk), F.col("size") - F.col("chunk_index") * chunk).cast("int")
    held = F.hex(F.coalesce("data", F.unhex(F.lit(""))))
    return every.join(laid, [key, "chunk_index"], "left").select(key, "chunk_index", F.unhex(F.rpad(held, 2 * size, "0")).alias("data"))


def segment_of(chunks: DataFrame, ranges: DataFrame, segments: DataFrame, chunk: str = "chunk_index") -> DataFrame:
    """Chunks with ``path``, the segment file that stores each: by the table range that holds its index."""
    found = locate(chunks, ranges, chunk, "first_chunk", "chunk_count", ["segment_index"])
    return found.join(segments.select("segment_index", "path"), "segment_index")
