"""Building segments: descriptors, tables, metadata and the order of sections."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from xml.sax.saxutils import escape

from sectorloom.kernels.catalog_text import Catalog, emit
from sectorloom.kernels.layout import HEADER_TAGS, MEDIA_LETTERS, MEDIA_TYPES, SECTIONS2, SIGNATURES

Ranges = tuple[tuple[int, int], ...]

#: Entries and payload bytes of a table of the first generation at most.
GROUP_ENTRIES, GROUP_BYTES = 16_375, 0x7FFFFFFF
Stored = tuple[str, bytes, int | None]
#: The size of a segment by its chunks, their stored bytes and its table groups.
Cost = Callable[[int, int, int], int]


@dataclass(frozen=True)
class Options:
    """What a container is written with; ``format`` is E01, L01, S01, Ex01 or Lx01."""

    format: str = "E01"
    sectors_per_chunk: int = 64
    bytes_per_sector: int = 512
    method: str = "zlib"
    level: int = 6
    set_identifier: bytes = b"\1" * 16
    headers: dict[str, str] = field(default_factory=dict)
    catalog: Catalog | None = None
    hashes: dict[str, str] = field(default_factory=dict)  # stored instead of the computed ones, and others than MD5 and SHA1
    media_type: str | None = None
    fastbloc: bool = False
    tableau: bool = False
    error_granularity: int = 0
    errors: Ranges = ()
    sessions: Ranges = ()
    tracks: Ranges = ()
    memory_extents: Ranges = ()
    aux_numbers: tuple[int, ...] = ()
    aux_digests: tuple[str, ...] = ()
    increments: tuple[bytes, ...] = ()
    restart: str | None = None
    analytical: str | None = None
    final: bytes | None = None

    def __post_init__(self):
        if not self.second and (self.memory_extents or self.aux_numbers or self.aux_digests or self.increments or self.restart or self.analytical or self.final):
            raise ValueError(f"{self.format} holds no memory extents, auxiliary tables or texts of the second generation")
        if self.format == "S01" and (self.errors or self.sessions or self.tracks):
            raise ValueError("S01 holds no error or session sections")
        if self.format not in ("E01", "L01", "S01", "Ex01", "Lx01"):
            raise ValueError(f"unknown format {self.format}")
        if not 0 < self.chunk_size <= 128 << 20:
            raise ValueError("chunk size must be between 1 byte and 128 MiB")
        if self.method not in (("none", "zlib", "bzip2") if self.second else ("none", "zlib")):
            raise ValueError(f"{self.format} can't be compressed by {self.method}")
        if self.catalog and self.format not in ("L01", "Lx01"):
            raise ValueError(f"{self.format} holds no catalog")

    @property
    def chunk_size(self) -> int:
        return self.sectors_per_chunk * self.bytes_per_sector

    @property
    def second(self) -> bool:
        return self.format in ("Ex01", "Lx01")

    @property
    def signature(self) -> bytes:
        kind = {"S01": "E01"}.get(self.format, self.format)
        return next(s for s, (f, _) in SIGNATURES.items() if f == kind)

    def check_ranges(self, sectors: int) -> None:
        """Raises unless errors are in order within the media, and sessions and tracks cover it without gaps."""
        for name, ranges, whole in (("errors", self.errors, False), ("sessions", self.sessions, True), ("tracks", self.tracks, True)):
            end = 0
            for first, count in ranges:
                if count <= 0:
                    raise ValueError(f"{name} hold an empty range")
                if first < end or whole and first != end:
                    raise ValueError(f"{name} overlap" if first < end else f"{name} leave a gap")
                end = first + count
                if end > sectors:
                    raise ValueError(f"{name} reach beyond the media")
                if not self.second and end >= 1 << 32:
                    raise ValueError(f"{name} don't fit 32 bits")
            if whole and ranges and end != sectors:
                raise ValueError(f"{name} end before the media")


def _summed(b: bytes) -> bytes:
    return b + struct.pack("<I", zlib.adler32(b))


def segment_name(stem: str, format: str, number: int) -> str:
    """stem.E01 to .E99, then .EAA to .ZZZ; the second generation's .Ex01, .ExAA to .EzZZ."""
    second, letter = format[1] == "x", format[0]
    if number <= 99:
        return f"{stem}.{letter}{'x' if second else ''}{number:02d}"
    block, rest = divmod(number - 100, 676)
    lead = chr(ord("x" if second else letter) + block)
    if lead > ("z" if second else "Z"):
        raise ValueError("too many segments")
    return f"{stem}.{letter if second else ''}{lead}{chr(65 + rest // 26)}{chr(65 + rest % 26)}"


def most_segments(format: str) -> int:
    """How many segments of a set ``segment_name`` can name."""
    return 99 + 676 * (3 if format[1] == "x" else ord("Z") - ord(format[0]) + 1)


def header_text(headers: dict[str, str]) -> str:
    tags = {v: k for k, v in HEADER_TAGS.items()}
    own = [(tags.get(k, k), v.translate({9: " ", 10: " ", 13: " "})) for k, v in headers.items()]
    return "1\nmain\n" + "\t".join(k for k, _ in own) + "\n" + "\t".join(v for _, v in own) + "\n\n"


def _counted(header: int, count: int, entries: bytes) -> bytes:
    """A table: its count in a checked header of the given size, the entries, and their checksum; padded in the second generation."""
    if header == 32:
        return _summed(struct.pack("<I12x", count)) + bytes(12) + _summed(entries) + bytes(12)
    return _summed(struct.pack("<I", count).ljust(header - 4, b"\0")) + _summed(entries)


def _session_entries(o: Options) -> list[tuple[int, int]]:
    """(start, flags), audio after others of one start."""
    return sorted([(first, 0) for first, _ in o.sessions] + [(first, 1) for first, _ in o.tracks])


def _xml(root: str, values: Iterable[tuple[str, str]]) -> bytes:
    quote = {'"': "&quot;", "'": "&apos;"}
    rows = "".join(f"\t<{k}>{escape(v, quote)}</{k}>\n" for k, v in values)
    return zlib.compress(f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n{rows}</{root}>\n'.encode())


def volume(o: Options, chunk_count: int, size: int) -> bytes:
    sectors = -(-size // o.bytes_per_sector)
    v = bytearray(90 if o.format == "S01" else 1048)
    codes = {name: code for code, name in MEDIA_TYPES.items()}
    v[0] = 1 if o.format == "S01" else codes[o.media_type] if o.media_type in codes else codes["single_files"] if o.format == "L01" else codes["removable"]
    struct.pack_into("<III", v, 4, chunk_count, o.sectors_per_chunk, o.bytes_per_sector)
    struct.pack_into("<I" if o.format == "S01" else "<Q", v, 16, sectors)
    if o.format == "S01":
        v[85:90] = b"SMART"
    else:
        v[36] = 1 | 2 * (o.format == "E01") | 4 * o.fastbloc | 8 * o.tableau
        v[52] = {0: 0, 1: 1, 9: 2}.get(o.level, 0)
        struct.pack_into("<I", v, 56, o.error_granularity)
        v[64:80] = o.set_identifier
    return _summed(bytes(v))


def lead1(o: Options, chunk_count: int, size: int) -> list[tuple[str, bytes]]:
    """Sections before the chunks of a first segment."""
    out = []
    known = {k: v for k, v in o.headers.items() if k in HEADER_TAGS.values()}
    if known:
        out += [("header", zlib.compress(header_text(known).encode())), ("header2", zlib.compress(b"\xff\xfe" + header_text(known).encode("utf-16-le")))]
    if others := sorted((k, v) for k, v in o.headers.items() if k not in known and k.replace("_", "").isalnum()):
        out.append(("xheader", _xml("xheader", others)))
    return [*out, ("volume", volume(o, chunk_count, size))]


def stored_hashes(o: Options, hashes: tuple[str, str] | None) -> dict[str, str]:
    """The hashes that a container stores: those of the options before the computed ones."""
    computed = {"MD5": hashes[0], "SHA1": hashes[1]} if hashes else {}
    return computed | {k.upper(): v.lower() for k, v in o.hashes.items()}


def tail1(o: Options, hashes: tuple[str, str] | None) -> list[tuple[str, bytes]]:
    """Sections after the chunks of a last segment."""
    out = []
    if entries := _session_entries(o):
        out.append(("session", _counted(36, len(entries), b"".join(struct.pack("<II24x", flags, start) for start, flags in entries))))
    if o.errors:
        out.append(("error2", _counted(520, len(o.errors), b"".join(struct.pack("<II", *e) for e in o.errors))))
    if o.catalog:
        text = emit(o.catalog)
        head = hashlib.md5(text).digest() + struct.pack("<QI", len(text), 0) + bytes(20)
        out.append(("ltree", head[:24] + struct.pack("<I", zlib.adler32(head)) + head[28:] + text))
    stored = stored_hashes(o, hashes)
    if "MD5" in stored or "SHA1" in stored:
        out.append(("digest", _summed(bytes.fromhex(stored.get("MD5", "0" * 32)) + bytes.fromhex(stored.get("SHA1", "0" * 40)) + bytes(40))))
    if others := sorted((k, v) for k, v in stored.items() if k not in ("MD5", "SHA1") and k.isalnum()):
        out.append(("xhash", _xml("xhash", others)))
    return out


def segment_cost(o: Options, size: int, chunk_count: int) -> Cost:
    """Bytes of a segment by its chunks, their bytes and table groups, if it held all sections that the set has."""
    none = ("0" * 32, "0" * 40)
    if o.second:
        fixed = 32 + 64 + sum(64 + len(d) for _, d in [*lead2(o, 1, chunk_count, size), *tail2(o, none)]) + 128 + 48
        return lambda chunks, payload, groups: fixed + payload + 16 * chunks
    fixed = 13 + 76 + sum(76 + len(d) for _, d in [*lead1(o, chunk_count, size), *tail1(o, none)])
    tables = 1 if o.format == "S01" else 2
    return lambda chunks, payload, groups: fixed + payload + 4 * tables * chunks + groups * (76 + tables * (104 if o.format != "S01" else 100))


def first_generation(o: Options, f: BinaryIO, number: int, chunks: Iterator[Stored], chunk_count: int, size: int, last: bool, hashes: tuple[str, str] | None) -> None:
    """Writes a segment; chunks pass through, and the descriptor before a group of them is written once their sizes are known."""

    def descriptor(kind: str, at: int, size: int, ends: bool = False) -> bytes:
        return _summed(kind.encode().ljust(16, b"\0") + struct.pack("<QQ", at if ends else at + 76 + size, 76 + size) + bytes(40))

    def section(kind: str, data: bytes, ends: bool = False) -> None:
        f.write(descriptor(kind, f.tell(), len(data), ends) + data)

    f.write(o.signature + struct.pack("<BHH", 1, number, 0))
    if number == 1:
        for kind, data in lead1(o, chunk_count, size):
            section(kind, data)
    entries: list[int] = []
    begin = offset = 0

    def close() -> None:
        f.seek(begin)
        f.write(descriptor("sectors", begin, offset))
        f.seek(begin + 76 + offset)
        table = _summed(struct.pack("<I4xQ4x", len(entries), begin + 76)) + struct.pack(f"<{len(entries)}I", *entries)
        # the last generation of one family keeps no checksum behind its entries
        section("table", table if o.format == "S01" else table + struct.pack("<I", zlib.adler32(table[24:])))
        if o.format != "S01":
            section("table2", table + struct.pack("<I", zlib.adler32(table[24:])))

    for kind, b, _ in chunks:
        if entries and (len(entries) == GROUP_ENTRIES or offset + len(b) > GROUP_BYTES):
            close()
            entries = []
        if not entries:
            begin, offset = f.tell(), 0
            f.write(bytes(76))
        entries.append(offset | (0x80000000 if kind == "zlib" else 0))
        offset += len(b)
        f.write(b)
    if entries:
        close()
    if last:
        for kind, data in tail1(o, hashes):
            section(kind, data)
    section("done" if last else "next", b"", ends=True)


def _text2(names: list[str], values: list[str]) -> bytes:
    s = "1\nmain\n" + "\t".join(names) + "\n" + "\t".join(values) + "\n\n"
    return zlib.compress(b"\xff\xfe" + s.encode("utf-16-le"))


# fixed values: tags of the case data
CASE_TAGS = {"case_number": "cn", "evidence_number": "en", "examiner_name": "ex", "description": "nm", "notes": "nt", "acquisition_version": "av", "acquisition_platform": "os", "acquisition_date": "at", "system_date": "tt"}


def lead2(o: Options, number: int, chunk_count: int, size: int) -> list[tuple[str, bytes]]:
    """Sections before the chunks of a segment of the second generation."""
    sectors = str(-(-size // o.bytes_per_sector))
    device = {"ts": sectors, "bp": str(o.bytes_per_sector), "ph": "1" if o.format == "Ex01" else "0", "sc": str(o.sectors_per_chunk), "tb": str(chunk_count)}
    letters = {name: letter for letter, name in MEDIA_LETTERS.items()}
    device |= {"dt": letters[o.media_type]} if o.media_type in letters else {}
    device |= {"gr": str(o.error_granularity)} if o.error_granularity else {}
    device |= {"wb": str(o.fastbloc + 2 * o.tableau)} if o.fastbloc or o.tableau else {}
    device |= {tag: o.headers[name] for tag, name in (("md", "model"), ("sn", "serial_number"), ("lb", "device_label"), ("pid", "process_identifier")) if o.headers.get(name)}
    own = [(CASE_TAGS[k], v.translate({9: " ", 10: " ", 13: " "})) for k, v in o.headers.items() if k in CASE_TAGS]
    out = [("device_information", _text2(list(device), list(device.values()))), ("case_data", _text2([k for k, _ in own] or ["cn"], [v for _, v in own] or [""]))]
    if number == 1 and o.catalog:
        out.append(("single_files_data", emit(o.catalog)))
    return out


def tail2(o: Options, hashes: tuple[str, str] | None) -> list[tuple[str, bytes]]:
    """Sections after the chunks of a last segment of the second generation."""
    out: list[tuple[str, bytes]] = []
    if o.errors:
        out.append(("error_table", _counted(32, len(o.errors), b"".join(struct.pack("<QI4x", *e) for e in o.errors))))
    if entries := _session_entries(o):
        out.append(("session_table", _counted(32, len(entries), b"".join(struct.pack("<QI20x", *e) for e in entries))))
    if o.memory_extents:
        out.append(("memory_extents_table", b"".join(struct.pack("<QQ", *e) for e in o.memory_extents)))
    out += [("increment_data", x) for x in o.increments]
    if o.aux_numbers:
        out.append(("single_files_table", _counted(32, len(o.aux_numbers), b"".join(x.to_bytes(8, "little") for x in o.aux_numbers))))
    if o.aux_digests:
        out.append(("single_files_md5_hash_table", _counted(32, len(o.aux_digests), b"".join(map(bytes.fromhex, o.aux_digests)))))
    stored = stored_hashes(o, hashes)
    if "MD5" in stored:
        out.append(("md5_hash", _summed(bytes.fromhex(stored["MD5"])) + bytes(12)))
    if "SHA1" in stored:
        out.append(("sha1_hash", _summed(bytes.fromhex(stored["SHA1"])) + bytes(8)))
    if o.final is not None:
        out.append(("final_information", o.final))
    for kind, text in (("analytical_data", o.analytical), ("restart_data", o.restart)):
        if text is not None:
            out.append((kind, zlib.compress(b"\xff\xfe" + text.encode("utf-16-le"))))
    return out


def second_generation(o: Options, f: BinaryIO, number: int, chunks: Iterator[Stored], first_chunk: int, chunk_count: int, size: int, last: bool, hashes: tuple[str, str] | None) -> None:
    """Writes a segment, descriptors after their data; chunks pass through."""
    previous = 0
    codes = {v: k for k, v in SECTIONS2.items()}

    def end(kind: str, n: int) -> None:
        nonlocal previous
        at = f.tell()
        f.write(_summed(struct.pack("<IIQQII", codes[kind], 0, previous, n, 64, 0) + bytes(28)))
        previous = at

    def section(kind: str, data: bytes) -> None:
        f.write(data)
        end(kind, len(data))

    f.write(o.signature + struct.pack("<BBHI", 2, 1, {"none": 0, "zlib": 1, "bzip2": 2}[o.method], number) + o.set_identifier)
    for kind, data in lead2(o, number, chunk_count, size):
        section(kind, data)
    entries, begin, n = [], f.tell(), 0
    for kind, b, word in chunks:
        flags = {"pattern": 5, "raw": 2}.get(kind, 1)
        entries.append(struct.pack("<QII", word if kind == "pattern" else begin + n, len(b), flags))
        n += len(b)
        f.write(b)
    end("sector_data", n)
    section("sector_table", _summed(struct.pack("<QI4x", first_chunk, len(entries))) + bytes(12) + _summed(b"".join(entries)) + bytes(12))
    if last:
        for kind, data in tail2(o, hashes):
            section(kind, data)
    section("done" if last else "next", b"")
