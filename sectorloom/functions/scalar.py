"""Scalar functions over container bytes and metadata, as Column expressions.

Arithmetic is ANSI: overflow raises. Malformed input raises or gives null as each function says.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- geometry and size rules


def chunk_count(size: Column, chunk: Column | int) -> Column:
    """Chunks of a logical size; 0 for nothing."""
    return F.ceil(size.cast("decimal(38,0)") / F.lit(chunk)).cast("long") if isinstance(chunk, int) else F.ceil(size.cast("decimal(38,0)") / chunk).cast("long")


def chunk_logical_size(size: Column, chunk: int, index: Column) -> Column:
    """Bytes of chunk ``index``; the last is short."""
    return F.greatest(F.least(size - index * chunk, F.lit(chunk)), F.lit(0)).cast("long")


def raw_size_cap(chunk: Column) -> Column:
    return chunk + 4


def zlib_size_cap(chunk: Column) -> Column:
    """The larger of the compressor's bound and of stored blocks of 512 bytes."""
    bound = chunk + F.shiftright(chunk, 12) + F.shiftright(chunk, 14) + F.shiftright(chunk, 25) + 13
    stored = chunk + F.floor((chunk + 511) / 512).cast("long") * 5 + 6
    return F.greatest(bound, stored)


def bzip2_size_cap(chunk: Column) -> Column:
    return chunk + F.floor(chunk / 100).cast("long") + 4096


def chunk_encoding(flagged: Column, encoded: Column, chunk: Column) -> Column:
    """zlib if flagged, or if the size is above the raw cap and within zlib's; else raw."""
    return F.when(flagged | ((encoded > raw_size_cap(chunk)) & (encoded <= zlib_size_cap(chunk))), F.lit("zlib")).otherwise(F.lit("raw"))


def padded(size: Column, sector: int) -> Column:
    """Size rounded up to whole sectors."""
    return (F.ceil(size / F.lit(sector)) * sector).cast("long")


def error_range(index: Column, size: Column, chunk: Column | int, sector: Column) -> tuple[Column, Column]:
    """First sector and sectors of a chunk, one at least; in bytes where the sector size is null or 0."""
    known = sector.isNotNull() & (sector != 0)
    at = index * chunk
    first = F.when(known, F.floor(at / sector)).otherwise(at).cast("long")
    count = F.when(known, F.ceil(size / sector)).otherwise(size)
    return first, F.greatest(count, F.lit(1)).cast("long")


# ---------------------------------------------------------------- bytes


def hex_lower(b: Column) -> Column:
    return F.lower(F.hex(b))


def strict_unhex(s: Column, size: int) -> Column:
    """The bytes that exactly ``2 * size`` hex digits name, else null."""
    return F.when(s.rlike(f"^[0-9A-Fa-f]{{{2 * size}}}$"), F.unhex(s))


def base16(s: Column) -> Column:
    """Lower-case hex; null if empty or all zero; anything but hex digits raises."""
    bad = F.raise_error(F.lit("Malformed: base16 text has other characters"))
    return F.when(s.rlike("^[0-9A-Fa-f]*$"), F.when(~s.rlike("^0*$"), F.lower(s))).otherwise(bad.cast("string"))


def nonzero_hash(b: Column, size: int) -> Column:
    """The first ``size`` bytes; null if they are too few or all zero."""
    first = F.substring(b, 1, size)
    return F.when((F.octet_length(b) >= size) & ~F.hex(first).rlike("^0*$"), first)


def repeats_pattern(b: Column) -> Column:
    """All bytes repeat the first eight; shorter data extend the seed by zeros."""
    h = F.hex(b)
    n = F.octet_length(b)
    return (n > 0) & (h == F.substring(F.repeat(F.rpad(F.substring(h, 1, 16), 16, "0"), F.ceil(n / 8).cast("int")), F.lit(1), 2 * n))


def all_zero(b: Column, chunk: int) -> Column:
    """A full chunk of zero bytes."""
    return (F.octet_length(b) == chunk) & F.hex(b).rlike("^0*$")


def _adler(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else zlib.adler32(x) for x in column.to_pylist()], pa.int64())


def adler32(b: Column) -> Column:
    return F.arrow_udf(_adler, "long")(b)


# ---------------------------------------------------------------- text


def sanitized(s: Column) -> Column:
    """Tabs and line ends as spaces."""
    return F.translate(s, "\t\n\r", "   ")


def xml_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def xml_unescaped(s: Column) -> Column:
    """For text in which every ampersand begins an entity."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def is_corruption(message: Column) -> Column:
    """Whether an error message names corruption rather than another malformation."""
    low = F.lower(message)
    return F.contains(low, F.lit("checksum")) | F.contains(low, F.lit("integrity hash")) | F.contains(low, F.lit("corrupt"))


# fixed values: signatures of the container families
SIGNATURES = {"455646090D0AFF00": "EWF1", "4C5646090D0AFF00": "L01", "455646320D0A8100": "EWF2", "4C4546320D0A8100": "LEF2"}


def signature_format(content: Column) -> Column:
    """The family that the first eight bytes name, else null."""
    h = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for sig, name in SIGNATURES.items():
        out = F.when(h == sig, F.lit(name)).otherwise(out)
    return out


def chunk_flags(bits: Column) -> Column:
    """A second-generation chunk's flags as (compressed, has_checksum, pattern); a pattern is a compressed chunk too."""
    bit = lambda n: bits.bitwiseAND(n) != 0
    return F.struct(bit(1).alias("compressed"), bit(2).alias("has_checksum"), (bit(4) & bit(1)).alias("pattern"))


def method_name(code: Column) -> Column:
    return F.when(code == 0, "none").when(code == 1, "zlib").when(code == 2, "bzip2").otherwise("unknown")


def tabular(text: Column) -> Column:
    """Names in the third line and values in the fourth, by tabs -> array<struct<identifier, value, ordinal>> by identifier; none of shorter text."""
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    pairs = F.arrays_zip(F.split(F.get(lines, F.lit(2)), "\t").alias("k"), F.split(F.get(lines, F.lit(3)), "\t").alias("v"))
    rows = F.array_sort(F.transform(F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != ""), lambda p: F.struct(p["k"].alias("identifier"), p["v"].alias("value"))))
    return F.transform(rows, lambda r, i: F.struct(r["identifier"].alias("identifier"), r["value"].alias("value"), (i + 1).cast("long").alias("ordinal")))


# ---------------------------------------------------------------- dates


def date_legacy(ts: Column) -> Column:
    """Year, month, day, hour, minute, second without leading zeros, by spaces."""
    return F.concat_ws(" ", *[f(ts).cast("string") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)])


def date_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def date_ctime(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss yyyy"))


def date_day_month(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm:ss")


def date_month_day(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm:ss")


def date_parsed(s: Column) -> Column:
    """The timestamp of header date text in the space, ISO, epoch or ctime form; null for other text."""
    legacy = F.when(s.rlike(r"^[0-9]{1,4}( [0-9]{1,2}){5}$"), F.try_to_timestamp(s, F.lit("y M d H m s")))
    iso = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z?$"), F.try_to_timestamp(F.rtrim(F.replace(F.replace(s, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))), F.lit("yyyy-MM-dd HH:mm:ss")))
    epoch = F.when(s.rlike(r"^[0-9]{1,12}$"), F.timestamp_seconds(s.try_cast("long")))
    plain = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3} ", ""), " +", " ")
    ctime = F.when(s.rlike(r"^[A-Za-z]{3} [A-Za-z]{3} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4}$"), F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss yyyy")))
    return F.coalesce(legacy, iso, epoch, ctime)


# ---------------------------------------------------------------- names


def segment_extension(n: Column, prefix: str, ewf2: bool = False) -> Column:
    """The extension of segment n from 1: two digits, then two letters, then the next letter before them; null beyond the last."""
    k = n - 100
    block, rest = F.floor(k / 676).cast("int"), F.pmod(k, F.lit(676))
    first, second = F.char(65 + F.floor(rest / 26)), F.char(65 + F.pmod(rest, F.lit(26)))
    lead, limit = ("x", ord("z")) if ewf2 else (prefix, ord("Z"))
    head = F.lit(prefix) if ewf2 else F.lit("")
    numbered = F.concat(head, F.lit(lead), F.lpad(n.cast("string"), 2, "0"))
    lettered = F.when(F.lit(ord(lead)) + block <= limit, F.concat(head, F.char(F.lit(ord(lead)) + block), first, second))
    return F.when((n >= 1) & (n <= 99), numbered).when(n >= 100, lettered)


def segment_matches(ext: Column, prefix: str, ewf2: bool = False) -> Column:
    """Whether an extension continues a set of the prefix."""
    p = prefix.upper()
    if ewf2:
        return ext.rlike(f"(?i)^{p}(x([0-9]{{2}}|[a-z]{{2}})|[yz][a-z]{{2}})$")
    later = "" if p == "Z" else f"|[{chr(ord(p) + 1)}-Z][A-Z]{{2}}"
    return ext.rlike(f"(?i)^({p}([0-9]{{2}}|[A-Z]{{2}}){later})$")


# ---------------------------------------------------------------- catalog text


def extents_parsed(s: Column) -> Column:
    """``n [S] offset size ...`` in hex -> array of (data_offset, data_size, sparse)."""
    parts = F.filter(F.split(s, " "), lambda x: x != "")
    shape = "array<struct<data_offset:bigint,data_size:bigint,sparse:boolean>>"
    state = F.struct(F.array().cast(shape).alias("out"), F.lit(False).alias("sparse"), F.lit(None).cast("bigint").alias("offset"))

    def step(a, x):
        number = F.when(x != "S", F.conv(x, 16, 10).cast("bigint"))
        done = (x != "S") & a["offset"].isNotNull()
        made = F.struct(a["offset"].alias("data_offset"), number.alias("data_size"), a["sparse"].alias("sparse"))
        return F.struct(
            F.when(done, F.concat(a["out"], F.array(made).cast(shape))).otherwise(a["out"]).alias("out"),
            F.when(x == "S", F.lit(True)).otherwise(F.when(done, F.lit(False)).otherwise(a["sparse"])).alias("sparse"),
            F.when(x == "S", F.lit(None).cast("bigint")).otherwise(F.when(done, F.lit(None).cast("bigint")).otherwise(number)).alias("offset"),
        )

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), state, step)["out"]


def short_name(s: Column) -> Column:
    """``length value`` with the length in bytes and one more -> the value; null if it doesn't fit."""
    at = F.instr(s, " ")
    value = F.substring(s, at + 1, F.length(s))
    return F.when((at > 0) & (F.substring(s, F.lit(1), at - 1).try_cast("int") == F.octet_length(value) + 1), value)
