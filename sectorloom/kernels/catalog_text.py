"""Logical file catalogs as text: categories whose columns a type line declares.

Each category is a table of tags: a column's name and how its text becomes a value. Rows come out as
dictionaries keyed by column; the tree is flattened in pre-order by an explicit stack, so depth costs
no recursion. Malformed names what is wrong.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from sectorloom.kernels.attributes import read_attributes, write_attributes
from sectorloom.kernels.codec import Malformed


def _integer(low: int, high: int) -> Callable[[str], int]:
    def convert(s: str) -> int:
        if not re.fullmatch(r"[+-]?[0-9]+", s) or not low <= int(s) <= high:
            raise Malformed(f"number {s!r} is out of range")
        return int(s)

    return convert


_u64, _u32, _i64, _i32, _id = _integer(0, (1 << 64) - 1), _integer(0, (1 << 32) - 1), _integer(-(1 << 63), (1 << 63) - 1), _integer(-(1 << 31), (1 << 31) - 1), _integer(0, (1 << 31) - 1)


def _hex(s: str) -> str | None:
    """Lower-case hex digits; null if all are zero."""
    if not re.fullmatch("[0-9A-Fa-f]*", s):
        raise Malformed("base16 text has other characters")
    return s.lower() if s.strip("0") else None


def _one(s: str) -> str:
    if len(s) != 1:
        raise Malformed("a drive type is one character")
    return s


def extents(s: str) -> list[tuple[int, int, bool]]:
    """``count [S] offset size ...`` in hex -> (offset, size, sparse)."""
    words = s.split(" ")
    if not all(w == "S" or re.fullmatch("[0-9A-Fa-f]{1,16}", w) for w in words):
        raise Malformed("extents hold other characters")
    out, at = [], 1
    while at < len(words):
        sparse = words[at] == "S"
        at += sparse
        if at + 2 > len(words) or "S" in words[at : at + 2]:
            raise Malformed("an extent is not whole")
        out.append((int(words[at], 16), int(words[at + 1], 16), sparse))
        at += 2
    if words[0] == "S" or int(words[0], 16) != len(out):
        raise Malformed("the count of extents differs")
    return out


def _short(s: str) -> str:
    size, _, value = s.partition(" ")
    if not size.isdigit() or int(size) != len(value.encode()) + 1:
        raise Malformed("a short name's length differs")
    return value


def _kind(s: str) -> str:
    return {"f": "file", "d": "directory"}.get(s, "unknown")


def _attributes(s: str) -> list[tuple[str | None, str | None]]:
    digits = re.sub(r"\s", "", s)
    if not re.fullmatch("([0-9A-Fa-f]{2})*", digits):
        raise Malformed("extended attributes are not hex")
    found = read_attributes(bytes.fromhex(digits))
    if found is None:
        raise Malformed("extended attributes are malformed")
    return found


_text = str
# fixed values: tags of the categories, the column of each and its type
SOURCES = {
    "id": ("identifier", _id), "n": ("name", _text), "ev": ("evidence_number", _text), "loc": ("location", _text), "gu": ("device_guid", _hex),
    "pgu": ("primary_device_guid", _hex), "dt": ("drive_type", _one), "mfr": ("manufacturer", _text), "mo": ("model", _text), "se": ("serial_number", _text),
    "do": ("domain", _text), "ip": ("ip_address", _text), "ma": ("mac_address", _hex), "tb": ("size", _u64), "lo": ("logical_offset", _i64),
    "po": ("physical_offset", _i64), "aq": ("acquisition_time", _i64), "ah": ("md5", _hex), "sh": ("sha1", _hex),
}
SUBJECTS = {"id": ("identifier", _u32), "n": ("name", _text)}
PERMISSIONS = {"n": ("name", _text), "s": ("identifier", _text), "pr": ("property_type", _u32), "pt": ("property_type", _u32), "nta": ("access_mask", _u32), "nti": ("ace_flags", _u32)}
ENTRIES = {
    "id": ("identifier", _u64), "p": ("type", _kind), "n": ("name", _text), "ls": ("size", _u64), "lo": ("logical_offset", _i64), "po": ("physical_offset", _i64),
    "du": ("duplicate_data_offset", _i64), "src": ("source_identifier", _id), "sub": ("subject_identifier", _u32), "pm": ("permission_group_index", _i32),
    "cid": ("record_type", _u32), "opr": ("flags", _u32), "be": ("extents", extents), "ha": ("md5", _hex), "sha": ("sha1", _hex), "snh": ("short_name", _short),
    "cr": ("creation_time", _i64), "wr": ("modification_time", _i64), "ac": ("access_time", _i64), "mo": ("entry_modification_time", _i64),
    "dl": ("deletion_time", _i64), "mid": ("guid", _hex), "ea": ("attributes", _attributes),
}
GROUP = 10


@dataclass
class Catalog:
    data_size: int = 0
    entries: list[dict] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)
    subjects: list[dict] = field(default_factory=list)
    groups: list[dict] = field(default_factory=list)


class _Lines:
    def __init__(self, data: bytes):
        if len(data) % 2:
            raise Malformed("catalog text has an odd size")
        try:
            text = data.decode("utf-16-le").removeprefix("﻿").rstrip("\0")
        except UnicodeDecodeError:
            raise Malformed("catalog text is not UTF-16") from None
        self.lines, self.at = [x.removesuffix("\r") for x in text.split("\n")], 0

    def take(self, what: str) -> str:
        if self.at >= len(self.lines):
            raise Malformed(f"{what} is truncated")
        self.at += 1
        return self.lines[self.at - 1]

    def expect(self, line: str, what: str) -> None:
        if self.take(what) != line:
            raise Malformed(f"{what} is not {line!r}")

    def pair(self, what: str) -> tuple[int, int]:
        words = self.take(what).split("\t")
        if len(words) != 2 or not all(w.isdigit() for w in words):
            raise Malformed(f"{what} is not a pair of numbers")
        return int(words[0]), int(words[1])

    def children(self, what: str, leads: tuple[int, ...] = (0,)) -> int:
        lead, n = self.pair(what)
        if lead not in leads:
            raise Malformed(f"{what} has an unknown shape")
        return n

    def counted(self, name: str) -> tuple[int, list[str]]:
        """A category's name, count and type line."""
        self.expect(name, f"{name} category")
        n, shape = self.pair(f"{name} count")
        if shape != 1:
            raise Malformed(f"{name} count has an unknown shape")
        return n, self.take(f"{name} types").split("\t")

    def row(self, types: list[str], tags: dict, what: str, exact: bool = True) -> dict:
        values = self.take(what).split("\t")
        if exact and len(values) != len(types):
            raise Malformed(f"{what} has {len(values)} values for {len(types)} types")
        out = {}
        for tag, value in zip(types, values, strict=False):
            if value and tag in tags:
                name, convert = tags[tag]
                out[name] = convert(value)
        return out


def parse(data: bytes) -> Catalog:
    """The catalog of a section's text. Entries carry entry_key, parent_key, depth and child_ordinal, in pre-order."""
    lines, out = _Lines(data), Catalog(len(data))
    lines.expect("5", "category count")
    lines.expect("rec", "record category")
    record = lines.row(lines.take("record types").split("\t"), {"tb": ("size", _u64)}, "record row", exact=False)
    out.data_size = record.get("size", len(data))
    lines.expect("", "record terminator")
    for name, tags in (("perm", PERMISSIONS), ("srce", SOURCES), ("sub", SUBJECTS)):
        n, types = lines.counted(name)
        if lines.children(f"{name} copy count") != n:
            raise Malformed(f"{name} counts differ")
        root = lines.row(types, tags, f"{name} root")
        rows = [] if name == "perm" else [root]
        if name == "perm" and root.get("property_type") != GROUP:
            raise Malformed("permission root has an unsupported type")
        for i in range(n):
            below = lines.children(f"{name} child count")
            row = lines.row(types, tags, f"{name} row")
            if name != "perm" and below:
                raise Malformed(f"{name} rows can't have children")
            if name == "perm":
                if row.get("property_type") != GROUP:
                    raise Malformed("permission group has an unsupported type")
                row["permissions"] = []
                for _ in range(below):
                    if lines.children("permission child count"):
                        raise Malformed("permissions can't have children")
                    row["permissions"].append(lines.row(types, tags, "permission row"))
            if name == "srce" and row.get("identifier") != i + 1:
                raise Malformed("source identifier does not match its place")
            rows.append(row)
        lines.expect("", f"{name} terminator")
        setattr(out, {"perm": "groups", "srce": "sources", "sub": "subjects"}[name], rows)
    _, types = lines.counted("entry")
    open_: list[list[int]] = [[-1, 1, 0]]  # of each level: the parent, the children to come and those read
    while open_:
        parent, left, read = open_[-1]
        if not left:
            open_.pop()
            continue
        open_[-1][1:] = [left - 1, read + 1]
        below = lines.children("entry child count", (0, 26))
        row = lines.row(types, ENTRIES, "entry row", exact=False)
        key = len(out.entries)
        out.entries.append(row | {"entry_key": key, "parent_key": None if parent < 0 else parent, "depth": len(open_) - 1, "child_ordinal": read})
        open_.append([key, below, 0])
    lines.expect("", "entry terminator")
    return out


# ---------------------------------------------------------------- writing


def _line(types: dict, row: dict) -> str:
    out, seen = [], set()
    for _, (name, _convert) in types.items():
        value = None if name in seen else row.get(name)
        seen.add(name)
        if value is None:
            out.append("")
        elif name == "extents":
            out.append(" ".join([f"{len(value):x}", *(f"{'S ' if s else ''}{a:x} {n:x}" for a, n, s in value)]) if value else "")
        elif name == "attributes":
            out.append(write_attributes(value).hex())
        elif name == "type":
            out.append({"file": "f", "directory": "d"}.get(value, "u"))
        elif name == "short_name":
            out.append(f"{len(value.encode()) + 1} {value}")
        else:
            out.append(str(value).translate({9: " ", 10: " ", 13: " "}))
    return "\t".join(out)


def emit(c: Catalog) -> bytes:
    """The text that parse reads back; sources are numbered by their place."""
    own = {k: v for k, v in PERMISSIONS.items() if k != "pt"}
    lines = ["5", "rec", "tb", str(c.data_size), ""]

    def category(name: str, tags: dict, root: dict, rows: list[dict]) -> None:
        lines.extend([name, f"{len(rows)}\t1", "\t".join(tags), f"0\t{len(rows)}", _line(tags, root)])
        for row in rows:
            below = row.get("permissions", [])
            lines.extend([f"0\t{len(below)}", _line(tags, row)])
            for p in below:
                lines.extend(["0\t0", _line(tags, p)])
        lines.append("")

    category("perm", own, {"property_type": GROUP}, [g | {"property_type": GROUP} for g in c.groups])
    category("srce", SOURCES, c.sources[0] if c.sources else {}, [s | {"identifier": i} for i, s in enumerate(c.sources[1:], 1)])
    category("sub", SUBJECTS, c.subjects[0] if c.subjects else {}, c.subjects[1:])
    below = [0] * len(c.entries)
    for e in c.entries:
        if e["parent_key"] is not None:
            below[e["parent_key"]] += 1
    lines.extend(["entry", f"{len(c.entries)}\t1", "\t".join(ENTRIES)])
    for e in c.entries:
        lines.extend([f"{0 if e['parent_key'] is None else 26}\t{below[e['entry_key']]}", _line(ENTRIES, e)])
    lines += ["", ""]
    return ("﻿" + "\n".join(lines)).encode("utf-16-le")
