"""Codes of container metadata as Column expressions: numbers, enumerations, code pages, header maps, attributes, paths.

Text that breaks a rule gives null, so that a caller can count, drop or raise by its own choice.
"""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sectorloom.kernels.attributes import read_attributes, write_attributes

# ---------------------------------------------------------------- numbers

_RANGES = {
    "u64": ("^[+]?[0-9]+$", "0", "18446744073709551615", "decimal(20,0)"),
    "u32": ("^[+]?[0-9]+$", "0", "4294967295", "bigint"),
    "i64": ("^[+-]?[0-9]+$", "-9223372036854775808", "9223372036854775807", "bigint"),
    "i32": ("^[+-]?[0-9]+$", "-2147483648", "2147483647", "int"),
    "non_negative": ("^[+-]?[0-9]+$", "0", "2147483647", "int"),
}


def number(s: Column, kind: str) -> Column:
    """The number that decimal digits name, null outside the kind's range; no blanks, a sign where the kind has one."""
    shape, least, most, out = _RANGES[kind]
    digits = F.regexp_replace(s, "^([+-]?)0+(?=[0-9])", "$1")
    value = F.when(s.rlike(shape) & (F.length(digits) <= 21), F.regexp_replace(digits, "^[+]", "").try_cast("decimal(38,0)"))
    return F.when(value.between(F.lit(least).cast("decimal(38,0)"), F.lit(most).cast("decimal(38,0)")), value.cast(out))


def hex_number(s: Column) -> Column:
    """The unsigned 64-bit number that hex digits name, else null."""
    digits = F.regexp_replace(s, "^[+]?0*(?=[0-9A-Fa-f])", "")
    return F.when(s.rlike("^[+]?[0-9A-Fa-f]+$") & (F.length(digits) <= 16), F.conv(digits, 16, 10).cast("decimal(20,0)"))


def number_pair(s: Column) -> Column:
    """Two numbers by one tab as a struct (first, second), else null."""
    parts = F.split(s, "\t")
    first, second = number(F.get(parts, F.lit(0)), "u64"), number(F.get(parts, F.lit(1)), "u64")
    return F.when((F.size(parts) == 2) & first.isNotNull() & second.isNotNull(), F.struct(first.alias("first"), second.alias("second")))


def hex_stream(s: Column) -> Column:
    """The bytes of hex digits with white space anywhere; null for an odd number of digits or other characters."""
    digits = F.regexp_replace(s, r"(?U)\s", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


# ---------------------------------------------------------------- enumerations

# fixed values: codes of media types in both generations, compression levels, header code pages, date formats, entry types
MEDIA_TYPES = {0x00: "removable", 0x01: "fixed", 0x03: "optical", 0x0E: "single_files", 0x10: "memory"}
MEDIA_LETTERS = {"c": "optical", "f": "fixed", "l": "single_files", "m": "memory", "r": "removable"}
COMPRESSION_LEVELS = {-1: "default", 0: "none", 1: "fast", 2: "best"}
CODE_PAGES = {20127: "ascii", 874: "windows-874", 932: "windows-932", 936: "windows-936", 1250: "windows-1250", 1251: "windows-1251", 1252: "windows-1252", 1253: "windows-1253", 1254: "windows-1254", 1255: "windows-1255", 1256: "windows-1256", 1257: "windows-1257", 1258: "windows-1258"}
DATE_FORMATS = {1: "day_month", 2: "month_day", 3: "iso", 4: "ctime"}
ENTRY_TYPES = {"f": "file", "d": "directory"}


def _table(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def named(code: Column, table: dict, other: str | None = None) -> Column:
    """The name of a code; ``other`` or null for one that the table lacks."""
    found = F.try_element_at(_table(table), code)
    return found if other is None else F.coalesce(found, F.when(code.isNotNull(), F.lit(other)))


def coded(name: Column, table: dict) -> Column:
    """The code of a name, else null."""
    return F.try_element_at(_table({v: k for k, v in table.items()}), name)


def compression_flags(bits: Column) -> Column:
    """A byte of flags as (empty_block, pattern_fill, unknown_bits)."""
    known = 0x11
    return F.struct((bits.bitwiseAND(0x01) != 0).alias("empty_block"), (bits.bitwiseAND(0x10) != 0).alias("pattern_fill"), bits.bitwiseAND(0xFF & ~known).alias("unknown_bits"))


def compression_bits(flags: Column) -> Column:
    """The byte of such flags."""
    one = lambda c, bit: F.when(c, F.lit(bit)).otherwise(F.lit(0))
    return flags["unknown_bits"].bitwiseOR(one(flags["empty_block"], 0x01)).bitwiseOR(one(flags["pattern_fill"], 0x10))


def media_flags(bits: Column, logical: Column) -> Column:
    """(physical, fastbloc, tableau) of a flags byte; without one, physical unless the container is logical."""
    bit = lambda n: F.coalesce(bits.bitwiseAND(n) != 0, F.lit(False))
    return F.struct(F.when(bits.isNull(), ~logical).otherwise(bit(0x02)).alias("physical"), bit(0x04).alias("fastbloc"), bit(0x08).alias("tableau"))


def media_bits(flags: Column) -> Column:
    """The flags byte of (physical, fastbloc, tableau); its lowest bit is always set."""
    one = lambda c, bit: F.when(c, F.lit(bit)).otherwise(F.lit(0))
    return F.lit(1) + one(flags["physical"], 2) + one(flags["fastbloc"], 4) + one(flags["tableau"], 8)


# ---------------------------------------------------------------- text

_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def entities_decoded(s: Column) -> Column:
    """The five named entities decoded in one pass; an ampersand takes the text up to the next semicolon with it, known or not."""
    parts = F.regexp_extract_all(s, F.lit("(?s)(&[^;]*;|&[^;]*$|[^&]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(_table(_NAMED), p), p)), "")


def utf16(s: Column, mark: bool = False, end: bool = False) -> Column:
    """UTF-16 little-endian bytes, after a byte-order mark and before a null character if wanted."""
    parts = [F.unhex(F.lit("FFFE"))] * mark + [F.encode(s, "UTF-16LE")] + [F.unhex(F.lit("0000"))] * end
    return F.concat(*parts)


_CODECS = {"windows-874": "cp874", "windows-932": "cp932", "windows-936": "gbk"}


def _codec(page: str) -> str | None:
    """The codec of a code page; ASCII is read and written as UTF-8."""
    return None if page == "ascii" else _CODECS.get(page, page.replace("windows-", "cp"))


def _unmapped(e: UnicodeError):
    """Bytes that a page leaves open: the control character of 0x80 to 0x9F, else a replacement; and the way back."""
    if isinstance(e, UnicodeDecodeError):
        byte = e.object[e.start]
        return (chr(byte) if byte < 0xA0 and not e.encoding.startswith(("cp932", "gbk")) else "�"), e.start + 1
    c = e.object[e.start]
    if 0x80 <= ord(c) < 0xA0 and e.encoding not in ("cp932", "gbk"):
        return bytes([ord(c)]), e.start + 1
    return f"&#{ord(c)};", e.start + 1


def page_decoded(b: Column, page: str) -> Column:
    """Text of bytes in a header code page; what can't be read becomes U+FFFD."""
    name = _codec(page)

    def run(column: pa.Array) -> pa.Array:
        codecs.register_error("sectorloom_page", _unmapped)
        return pa.array([None if x is None else x.decode("utf-8", "replace") if name is None else x.decode(name, "sectorloom_page") for x in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(b)


def page_encoded(s: Column, page: str) -> Column:
    """Bytes of text in a header code page; characters that it lacks become numeric references."""
    name = _codec(page)

    def run(column: pa.Array) -> pa.Array:
        codecs.register_error("sectorloom_page", _unmapped)
        return pa.array([None if x is None else x.encode() if name is None else x.encode(name, "sectorloom_page") for x in column.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(s)


# ---------------------------------------------------------------- header maps

# fixed values: the header identifiers that are listed first, in this order
STANDARD_HEADERS = ("case_number", "description", "examiner_name", "evidence_number", "notes", "acquisition_date", "system_date", "acquisition_platform", "acquisition_software", "acquisition_version", "password")


def header_set(headers: Column, identifier: Column, value: Column) -> Column:
    """The map with the identifier's value replaced or added."""
    rest = F.map_filter(headers, lambda k, _: k != identifier)
    return F.map_concat(rest, F.map_from_arrays(F.array(identifier), F.array(value)))


def header_list(headers: Column) -> Column:
    """array<struct<ordinal, identifier, value>>: the standard identifiers in their order, then the others by name."""
    place = lambda k: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(h) for h in STANDARD_HEADERS]), k), F.lit(0)), F.lit(len(STANDARD_HEADERS) + 1))
    rows = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(place(e["key"]).alias("place"), e["key"].alias("identifier"), e["value"].alias("value"))))
    return F.transform(rows, lambda r, i: F.struct((i + 1).cast("long").alias("ordinal"), r["identifier"].alias("identifier"), r["value"].alias("value")))


def typed_hash(identifier: Column, value: Column) -> Column:
    """Lower-case hex of a stored MD5 or SHA1, whatever the identifier's case; null for other identifiers or digits."""
    size = F.when(F.upper(identifier) == "MD5", 32).when(F.upper(identifier) == "SHA1", 40)
    return F.when((F.length(value) == size) & value.rlike("^[0-9A-Fa-f]*$"), F.lower(value))


def path_normalised(path: Column, here: str = "/") -> Column:
    """An absolute path without ``.`` and ``..``, by its text alone."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(here.rstrip("/") + "/"), path))
    start = F.array().cast("array<string>")

    def step(out, part):
        return F.when((part == "") | (part == "."), out).when(part == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), start, step), "/"))


# ---------------------------------------------------------------- extended attributes

ATTRIBUTES = "array<struct<name:string,value:string>>"


def attributes_parsed(s: Column) -> Column:
    """Extended attributes from their hex text; null if it is malformed, none of empty text."""

    def run(column: pa.Array) -> pa.Array:
        found = [None if x is None else read_attributes(x) for x in column.to_pylist()]
        rows = [None if f is None else [{"name": n, "value": v} for n, v in f] for f in found]
        return pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))

    return F.arrow_udf(run, ATTRIBUTES)(hex_stream(s))


def attributes_text(attributes: Column) -> Column:
    """The hex text of an array of (name, value); empty for none."""

    def run(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        return pa.array([None if r is None else write_attributes([(a["name"], a["value"]) for a in r]).hex() for r in rows], pa.string())

    return F.arrow_udf(run, "string")(attributes)
