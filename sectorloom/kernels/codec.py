"""Chunk codecs, checksums and size rules on plain bytes."""

from __future__ import annotations

import bz2
import zlib


class Malformed(ValueError):
    """Container bytes that break the format; the message says what."""


class Unsupported(ValueError):
    """A valid container that uses what isn't read here."""


def raw_cap(chunk: int) -> int:
    return chunk + 4


def zlib_cap(chunk: int) -> int:
    return max(chunk + (chunk >> 12) + (chunk >> 14) + (chunk >> 25) + 13, chunk + -(-chunk // 512) * 5 + 6)


def bzip2_cap(chunk: int) -> int:
    return chunk + chunk // 100 + 4096


def check(stored: int, data: bytes, what: str, present: bool = True) -> None:
    """Compares an Adler-32; with ``present``, a stored 0 means that there is none."""
    if (stored or not present) and zlib.adler32(data) != stored:
        raise Malformed(f"{what} checksum mismatch")


def inflated(data: bytes, most: int) -> bytes:
    out = zlib.decompressobj().decompress(data, most + 1)
    return out


def decode(encoding: str, data: bytes, size: int, pattern: int | None = None, has_checksum: bool = False) -> bytes:
    """A chunk's logical bytes; Malformed if they are not exactly ``size``."""
    if encoding == "pattern":
        seed = (pattern or 0).to_bytes(8, "little")
        return (seed * (-(-size // 8)))[:size]
    if encoding == "raw":
        if has_checksum:
            if len(data) < size + 4:
                raise Malformed("raw chunk is too short for its checksum")
            check(int.from_bytes(data[size : size + 4], "little"), data[:size], "chunk", present=False)
        if len(data) < size:
            raise Malformed("raw chunk is too short")
        return bytes(data[:size])
    try:
        out = inflated(data, size) if encoding == "zlib" else bz2.BZ2Decompressor().decompress(data, size + 1)
    except (zlib.error, OSError, EOFError) as e:
        raise Malformed(f"chunk decompression failed: {e}") from None
    if len(out) != size:
        raise Malformed(f"decoded chunk has {len(out)} bytes, expected {size}")
    return out


def repeated_pattern(data: bytes) -> int | None:
    """The 64-bit word that the data repeat, if they do."""
    if not data:
        return None
    seed = data[:8].ljust(8, b"\0")
    return int.from_bytes(seed, "little") if data == (seed * (-(-len(data) // 8)))[: len(data)] else None


def encode(data: bytes, chunk: int, method: str = "zlib", level: int = 6, patterns: bool = False, empty_blocks: bool = True) -> tuple[str, bytes, int | None]:
    """(encoding, stored bytes, pattern): a repeated word, a packed block of zeros, or the method's form if it is smaller than raw."""
    if patterns and (word := repeated_pattern(data)) is not None:
        return "pattern", b"", word
    if method == "none" and empty_blocks and not patterns and len(data) == chunk and not any(data):
        return "zlib", zlib.compress(data, 9), None
    if method != "none":
        packed = zlib.compress(data, level) if method == "zlib" else bz2.compress(data, 9)
        if len(packed) < len(data):
            return method, packed, None
    return "raw", data + zlib.adler32(data).to_bytes(4, "little"), None
