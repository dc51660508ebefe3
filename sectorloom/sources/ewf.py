"""A data source of container images: ``spark.read.format("ewf").option("table", ...).load(path)``.

Planning walks sections and metadata only; a chunk table is known by its place, and its entries are read
in slices of ``SLICE`` chunks, each fetching its own bytes; a task reads one, or several small ones. Tables: images, segments,
sections, table_ranges, header_values, hash_values, acquisition_errors, checksum_errors, sessions, tracks,
memory_extents, the catalog's, aux_entries, encoded_chunks, chunks.
"""

from __future__ import annotations

import glob
import os
import re
import urllib.parse
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sectorloom.functions.scalar import error_range
from sectorloom.kernels import layout as L
from sectorloom.kernels.catalog_text import Catalog
from sectorloom.kernels.codec import Malformed, decode
from sectorloom.operators.chunks import stream_hashes

SLICE = 1024
#: Bytes of chunks that a task reads at least, if there are as many.
READ_BYTES = 8 << 20

_ENTRY = {"identifier": "decimal(20,0)", "type": "string", "name": "string", "short_name": "string", "size": "bigint", "logical_offset": "bigint", "physical_offset": "bigint", "duplicate_data_offset": "bigint", "source_identifier": "int", "subject_identifier": "bigint", "permission_group_index": "int", "record_type": "bigint", "flags": "bigint", "guid": "string", "creation_time": "bigint", "modification_time": "bigint", "access_time": "bigint", "entry_modification_time": "bigint", "deletion_time": "bigint", "md5": "string", "sha1": "string"}
_SOURCE = {"identifier": "int", "name": "string", "evidence_number": "string", "location": "string", "device_guid": "string", "primary_device_guid": "string", "drive_type": "string", "manufacturer": "string", "model": "string", "serial_number": "string", "domain": "string", "ip_address": "string", "mac_address": "string", "size": "bigint", "logical_offset": "bigint", "physical_offset": "bigint", "acquisition_time": "bigint", "md5": "string", "sha1": "string"}
_PERMISSION = {"name": "string", "identifier": "string", "property_type": "bigint", "access_mask": "bigint", "ace_flags": "bigint"}


def _columns(lead: str, columns: dict[str, str]) -> str:
    return ", ".join([lead, *(f"{k} {v}" for k, v in columns.items())])


SCHEMAS = {
    "images": "image_id string, format string, segment_count int, chunk_size bigint, logical_size bigint, acquisition_complete boolean, sectors_per_chunk bigint, bytes_per_sector bigint, sector_count bigint, chunk_count bigint, set_identifier binary, compression_method string, compression_level int, profile string, media_type string, physical boolean, fastbloc boolean, tableau boolean, error_granularity bigint, md5 string, sha1 string, segment_set_size bigint",
    "segments": "image_id string, segment_index int, segment_number bigint, path string, length bigint",
    "sections": "image_id string, segment_index int, section_ordinal int, type string, data_offset bigint, data_size bigint, has_integrity_hash boolean, encrypted boolean",
    "table_ranges": "image_id string, segment_index int, first_chunk bigint, chunk_count bigint, base_offset bigint, data_end bigint",
    "header_values": "image_id string, identifier string, value string",
    "hash_values": "image_id string, identifier string, value string",
    "acquisition_errors": "image_id string, ordinal int, first_sector bigint, sector_count bigint",
    "checksum_errors": "image_id string, chunk_index bigint, logical_size int",
    "aux_entries": "image_id string, aux_table string, ordinal int, number decimal(20,0), digest string",
    "file_attributes": "image_id string, entry_key int, attribute_ordinal int, name string, value string",
    "sessions": "image_id string, ordinal int, first_sector bigint, sector_count bigint",
    "tracks": "image_id string, ordinal int, first_sector bigint, sector_count bigint",
    "memory_extents": "image_id string, ordinal int, start_page bigint, page_count bigint",
    "catalogs": "image_id string, data_size bigint",
    "file_entries": _columns("image_id string, entry_key int, parent_key int, depth int, child_ordinal int", _ENTRY),
    "file_extents": "image_id string, entry_key int, extent_ordinal int, data_offset bigint, data_size bigint, sparse boolean",
    "file_sources": _columns("image_id string, source_index int", _SOURCE),
    "file_subjects": "image_id string, subject_index int, identifier bigint, name string",
    "permission_groups": _columns("image_id string, group_index int", _PERMISSION),
    "permissions": _columns("image_id string, group_index int, ace_index int", _PERMISSION),
    "encoded_chunks": "image_id string, chunk_index bigint, logical_offset bigint, logical_size int, encoded_size bigint, encoding string, pattern decimal(20,0), has_checksum boolean, data binary",
    "chunks": "image_id string, chunk_index bigint, logical_offset bigint, logical_size int, corrupted boolean, data binary",
}

_extension = re.compile(r"\.([ELS])(x?)([0-9]{2}|[A-Z]{2})$", re.I)


def discover(path: str) -> list[list[str]]:
    """Segment files of the images at a file, a folder or a pattern, in order; a family has one stem and one letter."""
    found = glob.glob(path) if any(c in path for c in "*?[") else [os.path.join(path, f) for f in os.listdir(path)] if os.path.isdir(path) else None
    if found is None:
        stem, ext = os.path.splitext(path)
        letter, second = ext[1:2].upper(), ext[2:3].lower() in "xyz" and len(ext) == 5
        shape = rf"{letter}(x([0-9]{{2}}|[A-Z]{{2}})|[yz][A-Z]{{2}})" if second else rf"({letter}([0-9]{{2}}|[A-Z]{{2}})|[{chr(min(ord(letter) + 1, 90))}-Z][A-Z]{{2}})"
        here = [f for f in glob.glob(glob.escape(stem) + ".*") if re.fullmatch(shape, os.path.splitext(f)[1][1:], re.I)]
        want = _head(path)
        own = [f for f in here if f == path or _head(f) == want]
        return [sorted(own, key=lambda f: (os.path.splitext(f)[1].upper(), f))]
    firsts = sorted(f for f in found if re.search(r"\.[ELS]x?01$", f, re.I))
    return [discover(f)[0] for f in firsts]


def _head(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read(8)


def _reader(path: str) -> L.Read:
    def read(offset: int, size: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(size)

    return read


Opened = tuple[str, L.Read, int]


def opened(paths: list[str]) -> list[Opened]:
    """Segment files as (label, read, length)."""
    return [(p, _reader(p), os.path.getsize(p)) for p in paths]


class Image:
    """A segment set: parsed segments and what follows from them together."""

    def __init__(self, files: list[Opened], image_id: str):
        self.paths, self.image_id, self.segments = [f[0] for f in files], image_id, []
        chunk = 0
        for i, (path, read, length) in enumerate(files):
            kind = L.signature(read(0, 8))
            if kind is None:
                raise Malformed("invalid signature")
            first = self.segments[0] if self.segments else None
            s = L.parse1(read, length, chunk, first) if kind[1] == 1 else L.parse2(read, length)
            if s.number != i + 1:
                raise Malformed(f"segment number {s.number} at place {i + 1}")
            if first and (s.format != first.format or s.method != first.method or s.set_identifier not in (None, first.set_identifier)):
                raise Malformed("segments belong to different sets")
            for name, payload in s.payloads.items():
                if first and first.payloads.setdefault(name, payload) != payload:
                    raise Malformed(f"{name} does not match")
            chunk += sum(r.count for r in s.ranges)
            self.segments.append(s)
        # behind the last name of the first letter, later letters say nothing of the profile
        named = [p if i < L.OWN_LETTER else self.paths[0] for i, p in enumerate(self.paths)]
        self.profile = L.set_profile([(L.hinted_profile(p, s.format, s.smart), s.profile) for p, s in zip(named, self.segments, strict=True)])
        head = self.segments[0]
        self.chunk_size = head.chunk_size or 32_768
        self.chunks = max((r.first_chunk + r.count for s in self.segments for r in s.ranges), default=0)
        self.size = head.sector_count * head.bytes_per_sector or self.chunks * self.chunk_size
        self.headers = head.headers
        self.hashes: dict[str, str] = {}
        for s in self.segments:
            self.hashes = s.hashes | self.hashes
        self.sessions: list[tuple[int, int]] = []
        self.tracks: list[tuple[int, int]] = []
        for s in self.segments:
            for entries in s.session_tables:
                sessions, tracks = L.session_ranges(entries, s.sector_count or head.sector_count)
                self.sessions += sessions
                self.tracks += tracks
        self.memory_extents = [x for s in self.segments for x in s.memory_extents]
        self.aux: dict[str, list] = {}
        for s in self.segments:
            if self.aux.keys() & s.aux_tables.keys():
                raise Malformed("a second auxiliary table")
            self.aux |= s.aux_tables
        catalogs = [s.catalog for s in self.segments if s.catalog]
        if len(catalogs) > 1:
            raise Malformed("a second catalog")
        self.catalog = catalogs[0] if catalogs else None
        L.coverage([(r.first_chunk, r.count) for s in self.segments for r in s.ranges], -(-self.size // self.chunk_size))


class Slice(InputPartition):
    """Rows as they are, or entries of one table's range to be read from its segment."""

    def __init__(self, rows: list[tuple] | None = None, path: str = "", image_id: str = "", held: L.Range | None = None, begin: int = 0, end: int = 0, version: int = 1, smart: bool = False, method: str = "zlib", chunk_size: int = 0, size: int = 0):
        self.rows, self.path, self.image_id, self.held, self.begin, self.end = rows, path, image_id, held, begin, end
        self.version, self.smart, self.method, self.chunk_size, self.size = version, smart, method, chunk_size, size

    def entries(self, read: L.Read) -> Iterator[tuple]:
        """(chunk, offset or pattern, size, encoding, has_checksum or None) of the slice."""
        if self.version == 1:
            return ((*e, None) for e in L.chunks1(read, self.held, self.begin, self.end, self.chunk_size, self.smart))
        return L.chunks2(read, self.held, self.begin, self.end, self.chunk_size, self.method)


def slices(image: Image) -> Iterator[Slice]:
    """The image's chunk tables, SLICE entries at a time."""
    for path, s in zip(image.paths, image.segments, strict=True):
        for r in s.ranges:
            for i in range(0, r.count, SLICE):
                yield Slice(path=path, image_id=image.image_id, held=r, begin=i, end=min(i + SLICE, r.count), version=s.version, smart=s.smart, method=s.method, chunk_size=image.chunk_size, size=image.size)


class Slices(InputPartition):
    """What one task reads."""

    def __init__(self, parts: list[Slice]):
        self.parts = parts


def tasks(parts: Iterable[Slice]) -> Iterator[Slices]:
    """Slices put together up to READ_BYTES, so that small segments and small chunks don't make a task each."""
    held, chunks = [], 0
    for part in parts:
        n = part.end - part.begin
        if held and (chunks + n) * part.chunk_size > READ_BYTES:
            yield Slices(held)
            held, chunks = [], 0
        held.append(part)
        chunks += n
    if held:
        yield Slices(held)


class EwfReader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.path, self.table = options.get("path", ""), table
        self.segments = options.get("segments")
        self.zero_on_error = options.get("zeroonerror", "false").lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for paths in [self.segments.split("\n")] if self.segments else discover(self.path):
            image = Image(opened(paths), os.path.splitext(os.path.basename(paths[0]))[0])
            out += tasks(slices(image)) if self.table in ("chunks", "encoded_chunks", "checksum_errors") else [Slices([Slice(rows=list(self._metadata(image)))])]
        return out or [Slices([])]

    def _metadata(self, m: Image) -> Iterator[tuple]:
        head, k = m.segments[0], m.image_id
        if self.table == "images":
            yield k, head.format, len(m.segments), m.chunk_size, m.size, m.segments[-1].complete, head.sectors_per_chunk, head.bytes_per_sector, head.sector_count, m.chunks, head.set_identifier, head.method, head.compression_level, m.profile, head.media_type, head.physical if head.physical is not None else head.format in ("E01", "Ex01") and not head.smart, any(s.fastbloc for s in m.segments), any(s.tableau for s in m.segments), head.error_granularity or None, m.hashes.get("MD5"), m.hashes.get("SHA1"), sum(s.length for s in m.segments)
        elif self.table == "segments":
            yield from ((k, i, s.number, p, s.length) for i, (s, p) in enumerate(zip(m.segments, m.paths, strict=True)))
        elif self.table == "sections":
            yield from ((k, i, j, x.kind, x.data_offset, x.data_size, x.has_hash, x.encrypted) for i, s in enumerate(m.segments) for j, x in enumerate(s.sections))
        elif self.table == "table_ranges":
            yield from ((k, i, r.first_chunk, r.count, r.base, r.data_end) for i, s in enumerate(m.segments) for r in s.ranges)
        elif self.table == "header_values":
            yield from ((k, a, b) for a, b in sorted(m.headers.items()))
        elif self.table == "hash_values":
            yield from ((k, a, b) for a, b in sorted(m.hashes.items()))
        elif self.table == "aux_entries":
            from decimal import Decimal

            yield from ((k, name, i, Decimal(x) if isinstance(x, int) else None, x if isinstance(x, str) else None) for name, rows in m.aux.items() for i, x in enumerate(rows))
        elif self.table in ("catalogs", "file_attributes", "file_entries", "file_extents", "file_sources", "file_subjects", "permission_groups", "permissions"):
            if m.catalog:
                yield from self._catalog(m.image_id, m.catalog)
        elif self.table == "acquisition_errors":
            yield from ((k, i, a, n) for i, (a, n) in enumerate(head.errors))
        elif self.table in ("sessions", "tracks"):
            yield from ((k, i, a, n) for i, (a, n) in enumerate(m.sessions if self.table == "sessions" else m.tracks))
        elif self.table == "memory_extents":
            yield from ((k, i, a, n) for i, (a, n) in enumerate(m.memory_extents))

    def _catalog(self, k: str, c: Catalog) -> Iterator[tuple]:
        from decimal import Decimal

        def of(row: dict, columns: dict[str, str]) -> tuple:
            return tuple(None if (v := row.get(name)) is None else Decimal(v) if kind.startswith("decimal") else v for name, kind in columns.items())

        if self.table == "catalogs":
            yield k, c.data_size
        elif self.table == "file_entries":
            yield from ((k, e["entry_key"], e["parent_key"], e["depth"], e["child_ordinal"], *of(e, _ENTRY)) for e in c.entries)
        elif self.table == "file_extents":
            yield from ((k, e["entry_key"], i, a, n, s) for e in c.entries for i, (a, n, s) in enumerate(e.get("extents", [])))
        elif self.table == "file_attributes":
            yield from ((k, e["entry_key"], i, a, v) for e in c.entries for i, (a, v) in enumerate(e.get("attributes") or []))
        elif self.table == "file_sources":
            yield from ((k, i, *of(r, _SOURCE)) for i, r in enumerate(c.sources))
        elif self.table == "file_subjects":
            yield from ((k, i, r.get("identifier"), r.get("name")) for i, r in enumerate(c.subjects))
        elif self.table == "permission_groups":
            yield from ((k, i, *of(r, _PERMISSION)) for i, r in enumerate(c.groups))
        else:
            yield from ((k, i, j, *of(p, _PERMISSION)) for i, r in enumerate(c.groups) for j, p in enumerate(r["permissions"]))

    def read(self, partition: Slices) -> Iterator[tuple]:
        for part in partition.parts:
            if part.rows is not None:
                yield from part.rows
            else:
                yield from file_rows(part, part.path, self.table, self.zero_on_error)


def file_rows(part: Slice, path: str, table: str, zero_on_error: bool) -> Iterator[tuple]:
    """``chunk_rows`` of a slice whose segment lies at a path."""
    with open(path, "rb") as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        yield from chunk_rows(part, read, table, zero_on_error)


def chunk_rows(part: Slice, read: L.Read, table: str, zero_on_error: bool) -> Iterator[tuple]:
    """The rows of ``chunks``, ``encoded_chunks`` or ``checksum_errors`` of a slice, as read from its segment."""
    from decimal import Decimal

    for chunk, at, n, kind, checked in part.entries(read):
        offset = chunk * part.chunk_size
        size = min(part.chunk_size, part.size - offset)
        word = at if kind == "pattern" else None
        data = b"" if kind == "pattern" else read(at, n)
        has = n == size + 4 and kind == "raw" if checked is None else checked
        if table == "encoded_chunks":
            yield part.image_id, chunk, offset, size, n, kind, None if word is None else Decimal(word), has, data
            continue
        try:
            whole, bad = decode(kind, data, size, word, has), False
        except Malformed:
            if not zero_on_error and table != "checksum_errors":
                raise
            whole, bad = bytes(size), True
        if table == "chunks":
            yield part.image_id, chunk, offset, size, bad, whole
        elif bad:
            yield part.image_id, chunk, size


class EwfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ewf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "chunks")]

    def reader(self, schema) -> EwfReader:
        return EwfReader(dict(self.options), self.options.get("table", "chunks"))


def read_ewf(spark: SparkSession, path: str | list[str], table: str = "chunks", **options: str) -> DataFrame:
    """A table of the images at a path, or of the one whose segments are listed in order."""
    spark.dataSource.register(EwfDataSource)
    reader = spark.read.format("ewf").options(table=table, **options)
    return reader.option("segments", "\n".join(path)).load() if isinstance(path, list) else reader.load(path)


def read_ewf_bytes(segments: DataFrame, table: str = "chunks", zero_on_error: bool = False) -> DataFrame:
    """A table of images whose segments are rows (image_id, segment_index, content): no path is opened. One task reads an image."""
    kind = to_arrow_schema(_parse_datatype_string(SCHEMAS[table]))

    def run(rows):
        import pyarrow as pa

        columns = rows.select(["image_id", "segment_index", "content"]).to_pylist()
        columns.sort(key=lambda r: r["segment_index"])
        reads = {str(r["segment_index"]): lambda at, n, d=r["content"]: d[at : at + n] for r in columns}
        image = Image([(str(r["segment_index"]), reads[str(r["segment_index"])], len(r["content"])) for r in columns], columns[0]["image_id"])
        if table in ("chunks", "encoded_chunks", "checksum_errors"):
            found = [x for part in slices(image) for x in chunk_rows(part, reads[part.path], table, zero_on_error)]
        else:
            found = list(EwfReader({}, table)._metadata(image))
        cols = zip(*found, strict=True) if found else [[]] * len(kind)
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

    return segments.groupBy("image_id").applyInArrow(run, SCHEMAS[table])


def checksum_errors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(image_id, first_sector, sector_count): the sectors of chunks that can't be decoded, each range once."""
    bad = read_ewf(spark, path, "checksum_errors")
    shape = read_ewf(spark, path, "images").select("image_id", "chunk_size", "bytes_per_sector")
    first, count = error_range(F.col("chunk_index"), F.col("logical_size"), F.col("chunk_size"), F.col("bytes_per_sector"))
    return bad.join(F.broadcast(shape), "image_id").select("image_id", first.alias("first_sector"), count.alias("sector_count")).distinct()


def raw_export(spark: SparkSession, path: str | list[str], target: str) -> int:
    """Writes an image's media as one raw file that all executors can open: each task writes its chunks at their offsets. Returns the size."""
    size = read_ewf(spark, path, "images").first()["logical_size"]
    temporary = f"{target}.part"
    with open(temporary, "wb") as f:
        f.truncate(size)

    def run(batches):
        import pyarrow as pa

        done = 0
        with open(temporary, "r+b") as f:
            for b in batches:
                for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    f.seek(at)
                    f.write(data)
                    done += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    written = read_ewf(spark, path, "chunks").select("logical_offset", "data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if written != size:
        raise Malformed(f"{written} of {size} bytes were read")
    os.replace(temporary, target)
    return size


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, md5, sha1, md5_match, sha1_match): the stream's hashes against the stored ones; null where none is stored."""
    computed = stream_hashes(read_ewf(spark, path, "chunks"), "image_id")
    stored = read_ewf(spark, path, "hash_values").groupBy("image_id").pivot("identifier", ["MD5", "SHA1"]).agg(F.first("value"))
    named = stored.select("image_id", F.col("MD5").alias("stored_md5"), F.col("SHA1").alias("stored_sha1"))
    both = computed.join(named, "image_id", "left")
    return both.select("image_id", "size", "md5", "sha1", (F.col("md5") == F.col("stored_md5")).alias("md5_match"), (F.col("sha1") == F.col("stored_sha1")).alias("sha1_match"))


PROBED = "is_container boolean, encrypted boolean, corrupted boolean, message string"


def _probed(read: L.Read, length: int, geometry: L.Segment | None = None) -> tuple[bool, bool, bool, str | None]:
    """Whether a segment is a container's, encrypted, corrupted, and what opening it says; corruption by the error's words."""
    kind, message, encrypted = L.signature(read(0, 8)), None, False
    if kind:
        try:
            L.parse1(read, length, 0, geometry) if kind[1] == 1 else L.parse2(read, length)
        except L.Unsupported as e:
            encrypted, message = "encrypted" in str(e), str(e)
        except Malformed as e:
            message = str(e)
    low = (message or "").lower()
    return kind is not None, encrypted, any(w in low for w in ("checksum", "integrity hash", "corrupt")), message


def _local(path: str) -> str:
    return urllib.parse.unquote(re.sub("^file:/+", "/", path))


def probe(spark: SparkSession, path: str) -> DataFrame:
    """(path, is_container, encrypted, corrupted, message) of each file; only what opening reads is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(p, *_probed(_reader(_local(p)), n, _volume(_local(p)))) for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.bool_()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=["path", "is_container", "encrypted", "corrupted", "message"])

    return files.mapInArrow(run, f"path string, {PROBED}")


def _volume(path: str) -> L.Segment | None:
    """The geometry for a later segment, which holds no volume section of its own: that of the set's first; any will do if it can't be read."""
    read = _reader(path)
    head = read(0, 13)
    if L.signature(head) is None or int.from_bytes(head[9:11], "little") == 1:
        return None
    return L.Segment(sectors_per_chunk=64, bytes_per_sector=512)


def probe_sets(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, segment_count, encrypted, corrupted): of the images at a path, whether any of its segments is."""
    listed = [(os.path.splitext(os.path.basename(s[0]))[0], p) for s in discover(path) for p in s]
    rows = spark.createDataFrame(listed, "image_id string, path string")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [_probed(_reader(p), os.path.getsize(p), _volume(p)) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.bool_())], names=["image_id", "encrypted", "corrupted"])

    found = rows.mapInArrow(run, "image_id string, encrypted boolean, corrupted boolean")
    return found.groupBy("image_id").agg(F.count("*").alias("segment_count"), F.bool_or("encrypted").alias("encrypted"), F.bool_or("corrupted").alias("corrupted"))
