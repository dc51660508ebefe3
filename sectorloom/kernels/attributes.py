"""Extended attributes of catalog entries as bytes."""

from __future__ import annotations

import struct


def _record(name: str | None, value: str | None, branch: bool) -> bytes:
    """A record: four zero bytes, whether it is a branch, the lengths in UTF-16 units, name and value, each closed by a null character."""
    texts = [b"" if t is None else (t + "\0").encode("utf-16-le") for t in (name, value)]
    return struct.pack("<4xB2I", branch, *[len(t) // 2 for t in texts]) + b"".join(texts)


#: What attributes begin with.
LEAD = _record("Attributes", "", True)


def read_attributes(data: bytes) -> list[tuple[str | None, str | None]] | None:
    """(name, value) of the records that aren't branches; null if they break off or don't begin as they must."""
    if not data:
        return []
    if not data.startswith(LEAD):
        return None
    out, at = [], 0
    while at < len(data):
        if len(data) - at < 13:
            return None
        branch, *units = struct.unpack_from("<4xB2I", data, at)
        at += 13
        texts: list[str | None] = []
        for n in units:
            if at + 2 * n > len(data):
                return None
            try:
                text = data[at : at + 2 * n].decode("utf-16-le")
            except UnicodeDecodeError:
                return None
            at += 2 * n
            texts.append(text.removesuffix("\0") or None)
        if not branch:
            out.append((texts[0], texts[1]))
    return out


def write_attributes(attributes: list[tuple[str | None, str | None]]) -> bytes:
    """The bytes that read_attributes reads back; none for no attributes."""
    return LEAD + b"".join(_record(n, v, False) for n, v in attributes) if attributes else b""
