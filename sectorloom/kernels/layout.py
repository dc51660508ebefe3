"""Reading the layout of containers: sections, tables and metadata of a segment's bytes.

A segment is read through ``read(offset, size)``; nothing but descriptors, tables and metadata is
fetched. Errors name what is wrong; "checksum", "integrity hash" and "corrupt" mark corruption.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from sectorloom.kernels.catalog_text import Catalog, parse as parse_catalog
from sectorloom.kernels.codec import Malformed, Unsupported, bzip2_cap, check, raw_cap, zlib_cap

Read = Callable[[int, int], bytes]

# fixed values: signatures, and section numbers of the second generation
SIGNATURES = {b"EVF\t\r\n\xff\0": ("E01", 1), b"LVF\t\r\n\xff\0": ("L01", 1), b"EVF2\r\n\x81\0": ("Ex01", 2), b"LEF2\r\n\x81\0": ("Lx01", 2)}
SECTIONS2 = {
    0x01: "device_information", 0x02: "case_data", 0x03: "sector_data", 0x04: "sector_table", 0x05: "error_table", 0x06: "session_table",
    0x07: "increment_data", 0x08: "md5_hash", 0x09: "sha1_hash", 0x0A: "restart_data", 0x0B: "encryption_keys", 0x0C: "memory_extents_table",
    0x0D: "next", 0x0E: "final_information", 0x0F: "done", 0x10: "analytical_data", 0x20: "single_files_data", 0x21: "single_files_table",
    0x22: "single_files_md5_hash_table", 0x23: "single_files_unknown_table",
}
#: Segments of the first generation named by the set's own letter: .E01 to .E99, .EAA to .EZZ.
OWN_LETTER = 99 + 676
METHODS = {0: "none", 1: "zlib", 2: "bzip2"}
HEADER_TAGS = {
    "a": "description", "c": "case_number", "n": "evidence_number", "e": "examiner_name", "t": "notes", "av": "acquisition_version",
    "ov": "acquisition_platform", "m": "acquisition_date", "u": "system_date", "p": "password", "r": "compression_level", "md": "model", "sn": "serial_number",
}
MEDIA_TYPES = {0x00: "removable", 0x01: "fixed", 0x03: "optical", 0x0E: "single_files", 0x10: "memory"}
MEDIA_LETTERS = {"c": "optical", "f": "fixed", "l": "single_files", "m": "memory", "r": "removable"}
MOST_CHUNK = 128 << 20
MOST_METADATA = 16 << 20
#: Bytes of a table that a check reads at once.
PIECE = 64 << 10


@dataclass
class Section:
    kind: str
    offset: int
    data_offset: int
    data_size: int
    has_hash: bool = False
    encrypted: bool = False


@dataclass
class Range:
    """A run of chunks that one table describes, whose entries lie at ``entries_at``; they are read slice by slice."""

    first_chunk: int
    count: int
    base: int
    data_end: int
    entries_at: int


@dataclass
class Segment:
    format: str = ""
    number: int = 0
    version: int = 1
    method: str = "zlib"
    set_identifier: bytes | None = None
    length: int = 0
    sections: list[Section] = field(default_factory=list)
    ranges: list[Range] = field(default_factory=list)
    sectors_per_chunk: int = 0
    bytes_per_sector: int = 0
    sector_count: int = 0
    headers: dict[str, str] = field(default_factory=dict)
    hashes: dict[str, str] = field(default_factory=dict)
    errors: list[tuple[int, int]] = field(default_factory=list)
    session_tables: list[list[tuple[int, int]]] = field(default_factory=list)  # (start, flags) of each table
    memory_extents: list[tuple[int, int]] = field(default_factory=list)
    aux_tables: dict[str, list] = field(default_factory=dict)  # numbers or digests by section kind
    media_type: str | None = None
    physical: bool | None = None
    fastbloc: bool = False
    tableau: bool = False
    compression_level: int | None = None
    error_granularity: int = 0
    chunk_total: int = 0
    payloads: dict[str, bytes] = field(default_factory=dict)  # metadata that all segments must share
    profile: str | None = None
    smart: bool = False
    catalog: Catalog | None = None

    @property
    def chunk_size(self) -> int:
        return self.sectors_per_chunk * self.bytes_per_sector

    @property
    def complete(self) -> bool:
        return bool(self.sections) and self.sections[-1].kind != "next"


def signature(head: bytes) -> tuple[str, int] | None:
    return SIGNATURES.get(bytes(head[:8]))


def exact(read: Read, offset: int, size: int) -> bytes:
    data = read(offset, size)
    if len(data) != size:
        raise Malformed(f"{size} bytes at {offset} reach beyond the segment")
    return data


def _summed(read: Read, at: int, size: int, stored: int, what: str) -> None:
    """Checks an Adler-32, if there is one, over bytes that are read piece by piece."""
    if not stored:
        return
    found = 1
    for i in range(0, size, PIECE):
        found = zlib.adler32(exact(read, at + i, min(PIECE, size - i)), found)
    if found != stored:
        raise Malformed(f"{what} checksum mismatch")


# ---------------------------------------------------------------- first generation


def _sections1(read: Read, length: int) -> Iterator[Section]:
    at, ends = 13, 13
    while True:
        d = exact(read, at, 76)
        kind = d[:16].split(b"\0")[0].decode("ascii", "replace")
        following, size = struct.unpack_from("<QQ", d, 16)
        check(struct.unpack_from("<I", d, 72)[0], d[:72], "section descriptor")
        if size and size < 76:
            raise Malformed("section is smaller than its descriptor")
        if at < ends:
            raise Malformed("sections overlap")
        data = max(size - 76, 0)
        if at + 76 + data > length:
            raise Malformed("section reaches beyond the segment")
        yield Section(kind, at, at + 76, data)
        if kind in ("done", "next") or following == 0:
            return
        if following <= at:
            raise Malformed("section chain does not advance")
        ends, at = at + 76 + data, following


def _packed(data: bytes) -> bytes:
    """Inflated metadata; the bytes themselves if they aren't packed or would be too large."""
    try:
        out = zlib.decompressobj().decompress(data, MOST_METADATA + 1)
    except zlib.error:
        return data
    return out if len(out) <= MOST_METADATA else data


def tabular(text: str) -> dict[str, str]:
    """Names in the third line, values in the fourth."""
    lines = text.replace("\r", "").split("\n")
    if len(lines) < 4:
        return {}
    return {HEADER_TAGS.get(k, k): v for k, v in zip(lines[2].split("\t"), lines[3].split("\t"), strict=False) if v}


# fixed values: what a header's columns tell of the program that wrote it: (section, column's place or any, column, sections named or any, profile)
_PROFILES = (
    (1, 5, "av", None, "linen5"), (2, 5, "av", "1", "encase4"), (2, 5, "av", "3", "encase5"), (1, 5, "md", None, "linen6"), (2, 5, "md", None, "encase6"),
    (1, None, "l", None, "linen7"), (2, None, "l", None, "encase7"), (1, 8, "r", None, "encase1"),
)
DETECTED = ("encase1", "encase2", "encase3", "encase4", "encase5", "encase6", "encase7", "ftk_imager", "linen5", "linen6", "linen7")


def header_profile(text: str, section: int) -> str | None:
    """The acquisition profile by the columns of a header (section 1) or header2 (2); the last column that tells decides."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if len(lines) < 3:
        return None
    names, values = lines[2].split("\t"), (lines[3] if len(lines) > 3 else "").split("\t")
    version = next((values[i][:1] for i, n in enumerate(names) if n == "av" and i < len(values)), "")
    out = {"3": "linen5", "1": "encase1"}.get(lines[0]) if section == 1 else None
    for i, name in enumerate(names):
        for kind, place, column, sections, profile in _PROFILES:
            if kind == section and column == name and place in (None, i) and sections in (None, lines[0]):
                out = profile
        if section == 1 and i == 10 and name == "r":
            out = {"2": "encase2", "3": "encase3"}.get(version, out) if "\r" in text else "ftk_imager"
    return out


def hinted_profile(path: str, format: str, smart: bool) -> str:
    """The profile that a file's extension and layout suggest before its headers are read."""
    if format in ("Ex01", "Lx01"):
        return "encase7_ewf2" if format == "Ex01" else "logical_encase7_ewf2"
    if smart:
        return "smart"
    lead = path.rsplit(".", 1)[-1][:1] if "." in path else ""
    return {"e": "ewf", "E": "encase2", "L": "logical_encase5", "s": "smart", "S": "smart"}.get(lead, "unknown")


def set_profile(hints: list[tuple[str, str | None]]) -> str:
    """The profile of a set from each segment's (hint, detected): a detected one replaces a hint it agrees with; others must be equal."""
    known, only_hint = "unknown", True
    for hint, detected in hints:
        now, guess = hint, True
        if detected and (not hint.startswith(("smart", "logical", "encase7_ewf2")) or (hint, detected) == ("smart", "ftk_imager")):
            now, guess = detected, False
        fits = lambda h, d: h in ("encase2", "encase5", "ewf") and d in DETECTED
        if now == "unknown":
            continue
        if known in ("unknown", now):
            known, only_hint = now, guess and (only_hint or known != now)
        elif only_hint and not guess and fits(known, now):
            known, only_hint = now, False
        elif not (guess and not only_hint and fits(now, known)):
            raise Malformed(f"segment profiles {known} and {now} do not match")
    return known


def utf16(data: bytes) -> str | None:
    data = data[: len(data) // 2 * 2]
    try:
        return data.decode("utf-16-le").removeprefix("﻿") if data else None
    except UnicodeDecodeError:
        return None


def xml_children(text: str) -> dict[str, str]:
    entities = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
    plain = lambda s: re.sub(r"&([^;&]*);", lambda m: entities.get(m[1], m[0]), s)
    return {k: plain(v) for k, v in re.findall(r"<([A-Za-z0-9_]+)>([^<]*)</\1>", text)}


def _hash(data: bytes) -> str | None:
    return data.hex() if any(data) else None


def parse1(read: Read, length: int, first_chunk: int = 0, geometry: Segment | None = None) -> Segment:
    head = exact(read, 0, 13)
    found = signature(head)
    if found is None or found[1] != 1:
        raise Malformed("invalid signature")
    out = Segment(found[0], struct.unpack_from("<H", head, 9)[0], 1, length=length)
    for s in _sections1(read, length):
        out.sections.append(s)
        data = lambda s=s: exact(read, s.data_offset, s.data_size)
        if s.kind in ("volume", "disk", "data") and not out.bytes_per_sector and s.data_size >= 24:
            d = data()
            check(struct.unpack_from("<I", d, len(d) - 4)[0], d[:-4], "volume")
            out.smart = len(d) == 94
            out.sectors_per_chunk, out.bytes_per_sector = struct.unpack_from("<II", d, 8)
            out.sector_count = struct.unpack_from("<I" if out.smart else "<Q", d, 16)[0]
            if not out.smart and len(d) >= 80:
                out.media_type = MEDIA_TYPES.get(d[0], f"unknown({d[0]})")
                out.physical, out.fastbloc, out.tableau = bool(d[36] & 2), bool(d[36] & 4), bool(d[36] & 8)
                out.compression_level, out.error_granularity = d[52], struct.unpack_from("<I", d, 56)[0]
                if any(d[64:80]):
                    out.set_identifier = bytes(d[64:80])
        elif s.kind in ("header", "header2"):
            packed = _packed(data())
            text = packed.decode("utf-8", "replace") if s.kind == "header" else utf16(packed) or ""
            out.headers |= tabular(text)
            out.profile = header_profile(text, 1 if s.kind == "header" else 2) or out.profile
        elif s.kind == "xheader":
            out.headers = xml_children(_packed(data()).decode("utf-8", "replace")) | out.headers
        elif s.kind in ("hash", "digest"):
            d = data()
            if len(d) < (36 if s.kind == "hash" else 80):
                raise Malformed(f"{s.kind} section is too short")
            end = 32 if s.kind == "hash" else 76
            check(struct.unpack_from("<I", d, end)[0], d[:end], s.kind, present=False)
            for name, value in (("MD5", _hash(d[:16])), ("SHA1", _hash(d[16:36]) if s.kind == "digest" else None)):
                if value:
                    out.hashes.setdefault(name, value)
        elif s.kind == "xhash":
            for k, v in xml_children(_packed(data()).decode("utf-8", "replace")).items():
                out.hashes.setdefault(k.upper(), v.strip().lower())
        elif s.kind == "ltree":
            d = data()
            n = struct.unpack_from("<Q", d, 16)[0] if len(d) >= 48 else 0
            if len(d) < 48 or 48 + n > len(d):
                raise Malformed("ltree section is too short")
            check(struct.unpack_from("<I", d, 24)[0], d[:24] + bytes(4) + d[28:48], "ltree header", present=False)
            out.catalog = _once(out.catalog, parse_catalog(d[48 : 48 + n]))
        elif s.kind == "error2":
            out.errors += _pairs(data(), 520, 8, "<II", "error2")
        elif s.kind == "session":
            out.session_tables.append([(start, flags) for flags, start in _pairs(data(), 36, 32, "<II", "session")])
    geometry = geometry or out
    if not geometry.chunk_size:
        raise Malformed("no volume section")
    if geometry.chunk_size > MOST_CHUNK:
        raise Malformed("chunk size exceeds maximum")
    out.ranges = list(_ranges1(read, out.sections, first_chunk))
    return out


def _pairs(d: bytes, header: int, size: int, layout: str, what: str, summed: int = 0) -> list[tuple[int, int]]:
    """Entries of an error or session table, behind a header whose first ``summed`` bytes are checked and before a checked footer."""
    summed = summed or header - 4
    if len(d) < header:
        raise Malformed(f"{what} table is too short")
    n = struct.unpack_from("<I", d, 0)[0]
    check(struct.unpack_from("<I", d, summed)[0], d[:summed], f"{what} header", present=False)
    if not n:
        return []
    end = header + n * size
    if end + (16 if header == 32 else 4) > len(d):
        raise Malformed(f"{what} entries exceed the section")
    check(struct.unpack_from("<I", d, end)[0], d[header:end], f"{what} entries", present=False)
    return [struct.unpack_from(layout, d, header + i * size) for i in range(n)]


def session_ranges(entries: list[tuple[int, int]], total: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(first_sector, sector_count) of the sessions and of the audio tracks of one table; the first entry only seeds."""
    sessions: list[tuple[int, int]] = []
    tracks: list[tuple[int, int]] = []
    if not entries:
        return sessions, tracks
    session = track = 0
    (before, flags), audio = entries[0], False
    for start, now in entries[1:]:
        if start < before:
            raise Malformed("session start sector moves backwards")
        if not now & 1:
            sessions.append((session, start - session))
            session = start
        if flags & 1:
            tracks.append((track, start - track))
            track = start
        before, flags, audio = start, now, bool(now & 1)
    sessions.append((session, max(0, total - session)))
    if audio:
        tracks.append((track, max(0, total - track)))
    return sessions, tracks


def _ranges1(read: Read, sections: list[Section], first_chunk: int) -> Iterator[Range]:
    data_sections = [s for s in sections if s.kind == "sectors"]
    chunk, prior = first_chunk, None
    for s in sections:
        if s.kind not in ("table", "table2"):
            continue
        if s.data_size < 24:
            raise Malformed("table section is too short")
        head = exact(read, s.data_offset, 24)
        check(struct.unpack_from("<I", head, 20)[0], head[:20], "table header")
        n, base = struct.unpack_from("<I4xQ", head)
        if not n:
            continue
        if s.kind == "table2" and prior == ("table", n, base):
            continue  # a mirror
        prior = (s.kind, n, base)
        end = 24 + 4 * n
        if end > s.data_size:
            raise Malformed("table entries exceed section")
        first = struct.unpack("<I", exact(read, s.data_offset + 24, 4))[0] & 0x7FFFFFFF
        bare = base == 0 and first == s.data_offset + end
        if s.data_size >= end + 4 and not bare:
            _summed(read, s.data_offset + 24, 4 * n, struct.unpack("<I", exact(read, s.data_offset + end, 4))[0], "table entries")
        holder = next((x for x in data_sections if base and x.offset <= base <= x.data_offset + x.data_size), None)
        holder = holder or next((x for x in data_sections if not base and x.data_offset <= first < x.data_offset + x.data_size), None)
        data_end = holder.data_offset + holder.data_size if holder else s.data_offset + s.data_size
        yield Range(chunk, n, base, data_end, s.data_offset + 24)
        chunk += n


def chunks1(read: Read, r: Range, begin: int, end: int, chunk_size: int, smart: bool) -> Iterator[tuple[int, int, int, str]]:
    """(chunk, offset, size, encoding) of the entries begin to end of a first-generation range; sizes follow from the next entry."""
    held = min(end + 2, r.count) - begin
    raws = dict(enumerate(struct.unpack(f"<{held}I", exact(read, r.entries_at + 4 * begin, 4 * held)), begin))
    wide = r.data_end - r.base > 0x80000000

    def entry(i: int, ahead: bool) -> tuple[int, bool]:
        raw = raws[i]
        short, full = r.base + (raw & 0x7FFFFFFF), r.base + raw
        if not raw & 0x80000000 or not wide or full >= r.data_end:
            return short, bool(raw & 0x80000000)
        if ahead and i + 1 < r.count:
            following = r.base + (raws[i + 1] & 0x7FFFFFFF)
            if 0 < following - short <= zlib_cap(chunk_size):
                return short, True
            reach = (r.base + raws[i + 1] if raws[i + 1] & 0x80000000 else following) - full
            return (full, False) if 0 < reach <= raw_cap(chunk_size) else (short, True)
        if i + 1 == r.count and r.data_end - short > zlib_cap(chunk_size) and r.data_end - full <= raw_cap(chunk_size):
            return full, False
        return short, True

    for i in range(begin, end):
        at, flagged = entry(i, True)
        size = (entry(i + 1, False)[0] if i + 1 < r.count else r.data_end) - at
        if size <= 0:
            raise Malformed("chunk offsets are not ordered")
        packed = flagged or raw_cap(chunk_size) < size <= zlib_cap(chunk_size)
        most = (2 * chunk_size if smart or size > zlib_cap(chunk_size) else zlib_cap(chunk_size)) if packed else raw_cap(chunk_size)
        if size > most:
            raise Malformed(f"encoded chunk size {size} exceeds maximum {most}")
        yield r.first_chunk + i, at, size, "zlib" if packed else "raw"


# ---------------------------------------------------------------- second generation


def _descriptor2(read: Read, at: int) -> tuple[Section, bytes, int, int]:
    """The section that a descriptor names, its data's place still open; the data's digest; the previous descriptor; the padding."""
    d = exact(read, at, 64)
    kind, flags, previous, size, own, padding = struct.unpack_from("<IIQQII", d)
    if own != 64 or kind not in SECTIONS2:
        raise Malformed(f"section descriptor of type {kind} is not valid")
    check(struct.unpack_from("<I", d, 60)[0], d[:60], "section descriptor")
    if padding > size:
        raise Malformed("section padding exceeds its data")
    section = Section(SECTIONS2[kind], at, 0, size, bool(flags & 1), bool(flags & 2))
    if section.encrypted or section.kind == "encryption_keys":
        raise Unsupported("encrypted container")
    return section, bytes(d[32:48]), previous, padding


def _valid2(read: Read, at: int, length: int) -> bool:
    """Whether a descriptor may stand here: one of a known type, whose data end within the segment."""
    if at + 64 > length:
        return False
    kind, _, _, size, own, _ = struct.unpack_from("<IIQQII", exact(read, at, 64))
    return own == 64 and kind in SECTIONS2 and at + 64 + size <= length


def _leading2(read: Read, length: int) -> Iterator[tuple[Section, bytes]]:
    """From the first descriptor on, each before its data and their padding."""
    at = 32
    while True:
        if not _valid2(read, at, length):
            raise Malformed("section descriptor before its data is not valid")
        section, digest, _, padding = _descriptor2(read, at)
        section.data_offset = at + 64
        if (after := section.data_offset + section.data_size + padding) > length:
            raise Malformed("section padding reaches beyond the segment")
        yield section, digest
        if section.kind in ("done", "next"):
            return
        at = after


def _trailing2(read: Read, length: int) -> list[tuple[Section, bytes]]:
    """From the last descriptor back, as each follows its data; the data begin where the descriptor before ends."""
    out, at = [], length - 64
    while True:
        section, digest, previous, _ = _descriptor2(read, at)
        if previous and not 32 <= previous <= at - 64:
            raise Malformed("section chain does not go back")
        section.data_offset = previous + 64 if previous else 32
        if section.data_offset + section.data_size > at:
            raise Malformed("section reaches beyond its descriptor")
        out.append((section, digest))
        if not previous:
            return out[::-1]
        at = previous


def _sections2(read: Read, length: int) -> tuple[list[tuple[Section, bytes]], bool]:
    """The sections with their digests, and whether descriptors stand before the data: they do if one stands behind the header."""
    if length < 96:
        raise Malformed("segment is too short")
    leading = _valid2(read, 32, length)
    return (list(_leading2(read, length)) if leading else _trailing2(read, length)), leading


def _aux(d: bytes, size: int, what: str) -> list[bytes]:
    """Entries of an auxiliary table of logical files; both checksums may be missing."""
    if len(d) < 36:
        raise Malformed(f"{what} is too short")
    check(struct.unpack_from("<I", d, 16)[0], d[:16], f"{what} header")
    end = 32 + size * struct.unpack_from("<I", d)[0]
    if end + 4 > len(d):
        raise Malformed(f"{what} entries exceed the section")
    check(struct.unpack_from("<I", d, end)[0], d[32:end], what)
    return [d[i : i + size] for i in range(32, end, size)]


def _once(before: Catalog | None, now: Catalog) -> Catalog:
    if before is not None:
        raise Malformed("a second catalog")
    return now


def _plain2(data: bytes) -> bytes:
    if data[:2] in (b"x\x01", b"x\x5e", b"x\x9c", b"x\xda"):
        return _packed(data)
    if data[:3] == b"BZh":
        import bz2

        return bz2.BZ2Decompressor().decompress(data, MOST_METADATA)
    return data


def parse2(read: Read, length: int) -> Segment:
    head = exact(read, 0, 32)
    found = signature(head)
    if found is None or found[1] != 2:
        raise Malformed("invalid signature")
    method, number = struct.unpack_from("<HI", head, 10)
    if method not in METHODS:
        raise Unsupported(f"compression method {method}")
    out = Segment(found[0], number, 2, METHODS[method], bytes(head[16:32]), length)
    sections, leading = _sections2(read, length)
    for s, digest in sections:
        out.sections.append(s)
        data = lambda s=s: exact(read, s.data_offset, s.data_size)
        if s.has_hash and _digest(read, s) != digest:
            raise Malformed(f"{s.kind} integrity hash mismatch")
        if s.kind in ("device_information", "case_data"):
            plain = _plain2(data())
            if out.payloads.setdefault(s.kind, plain) != plain:
                raise Malformed(f"{s.kind} does not match")
            lines = (utf16(plain) or "").replace("\r", "").split("\n")
            fields = dict(zip(lines[2].split("\t"), lines[3].split("\t"), strict=False)) if len(lines) > 3 else {}
            if s.kind == "device_information":
                _device(out, fields)
            else:
                _geometry(out, fields)
            own = _CASE if s.kind == "case_data" else _DEVICE
            out.headers |= {own[k]: v for k, v in fields.items() if v and k in own}
        elif s.kind in ("md5_hash", "sha1_hash"):
            n = 16 if s.kind == "md5_hash" else 20
            d = data()
            if len(d) < n + 4:
                raise Malformed(f"{s.kind} section is too short")
            check(struct.unpack_from("<I", d, n)[0], d[:n], s.kind, present=False)
            if value := _hash(d[:n]):
                out.hashes.setdefault("MD5" if n == 16 else "SHA1", value)
        elif s.kind == "single_files_data":
            out.catalog = _once(out.catalog, parse_catalog(_plain2(data())))
        elif s.kind == "error_table":
            out.errors += _pairs(data(), 32, 16, "<QI", "error", 16)
        elif s.kind == "session_table":
            out.session_tables.append(_pairs(data(), 32, 32, "<QI", "session", 16))
        elif s.kind == "memory_extents_table":
            d = data()
            if len(d) % 16:
                raise Malformed("memory extents table has a partial entry")
            out.memory_extents += struct.iter_unpack("<QQ", d)
        elif s.kind == "sector_table":
            # a table that follows its descriptor may lack the padding behind its header
            least = 20 if leading else 32
            if s.data_size < least:
                raise Malformed("sector table is too short")
            d = exact(read, s.data_offset, least)
            check(struct.unpack_from("<I", d, 16)[0], d[:16], "table header")
            first, n = struct.unpack_from("<QI", d)
            if not n:
                continue
            begin = 32 if s.data_size >= 32 + 16 * n else least
            end = begin + 16 * n
            if end > s.data_size:
                raise Malformed("table entries exceed section")
            if s.data_size >= end + 4:
                _summed(read, s.data_offset + begin, 16 * n, struct.unpack("<I", exact(read, s.data_offset + end, 4))[0], "table entries")
            out.ranges.append(Range(first, n, 0, 0, s.data_offset + begin))
        elif s.kind in ("single_files_table", "single_files_unknown_table", "single_files_md5_hash_table"):
            if s.kind in out.aux_tables:
                raise Malformed(f"a second {s.kind}")
            digests = s.kind == "single_files_md5_hash_table"
            out.aux_tables[s.kind] = [x.hex() if digests else int.from_bytes(x, "little") for x in _aux(data(), 16 if digests else 8, s.kind)]
    return out


def _digest(read: Read, s: Section) -> bytes:
    found = hashlib.md5()
    for i in range(0, s.data_size, PIECE):
        found.update(exact(read, s.data_offset + i, min(PIECE, s.data_size - i)))
    return found.digest()


def _number(fields: dict[str, str], *names: str) -> int:
    return next((int(fields[k]) for k in names if fields.get(k, "").isdigit()), 0)


def _geometry(out: Segment, fields: dict[str, str]) -> None:
    """Fills what is missing; the sector count follows from the chunks where it isn't named."""
    out.bytes_per_sector = out.bytes_per_sector or _number(fields, "bp", "b")
    out.sectors_per_chunk = out.sectors_per_chunk or _number(fields, "sc", "sb")
    out.chunk_total = out.chunk_total or _number(fields, "tb")
    out.sector_count = out.sector_count or _number(fields, "ts")
    out.error_granularity = out.error_granularity or _number(fields, "gr")


def _device(out: Segment, fields: dict[str, str]) -> None:
    _geometry(out, fields)
    out.sector_count = out.sector_count or out.sectors_per_chunk * out.chunk_total
    if len(kind := fields.get("dt", "")) == 1:
        out.media_type = MEDIA_LETTERS.get(kind, f"unknown({ord(kind)})")
    if fields.get("ph") in ("0", "1"):
        out.physical = fields["ph"] == "1"
    blockers = _number(fields, "wb")
    out.fastbloc, out.tableau = out.fastbloc or bool(blockers & 1), out.tableau or bool(blockers & 2)


# fixed values: names of the case and device fields
_CASE = {"ad": "acquisition_date", "at": "acquisition_date", "av": "acquisition_version", "cn": "case_number", "cp": "compression_method", "de": "description", "nm": "description", "en": "evidence_number", "ex": "examiner_name", "nt": "notes", "os": "acquisition_platform", "ov": "acquisition_platform", "sd": "system_date", "tt": "system_date"}
_DEVICE = {"lb": "device_label", "md": "model", "pid": "process_identifier", "sn": "serial_number"}


def chunks2(read: Read, r: Range, begin: int, end: int, chunk_size: int, method: str) -> Iterator[tuple[int, int, int, str, bool]]:
    """(chunk, offset or pattern, size, encoding, has_checksum) of the entries begin to end of a second-generation range."""
    for i, (at, size, flags) in enumerate(struct.iter_unpack("<QII", exact(read, r.entries_at + 16 * begin, 16 * (end - begin))), begin):
        kind = "pattern" if flags & 5 == 5 else method if flags & 1 else "raw"
        if kind == "none":
            raise Malformed("compressed chunk in a container without compression")
        if kind != "pattern":
            most = {"raw": raw_cap, "zlib": zlib_cap, "bzip2": bzip2_cap}[kind](chunk_size)
            if not 0 < size <= most:
                raise Malformed(f"encoded chunk size {size} exceeds maximum {most}")
        yield r.first_chunk + i, at, size, kind, bool(flags & 2)


def coverage(ranges: list[tuple[int, int]], chunks: int) -> None:
    """Raises unless the (first, count) ranges cover 0 to chunks without gap or overlap."""
    at = 0
    for first, count in sorted(ranges):
        if count <= 0:
            raise Malformed("empty table range")
        if first != at:
            raise Malformed("table ranges leave a gap" if first > at else "table ranges overlap")
        at = first + count
    if at != chunks:
        raise Malformed(f"table ranges end at chunk {at}, expected {chunks}")
