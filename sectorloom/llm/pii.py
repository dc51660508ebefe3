"""Personal data: offset-preserving transducers, detection, and spans mapped back to the source characters.

The base patterns read the text as it stands. Then transducers rewrite it, each keeping for every
character it emits the source span that made it: homoglyphs and invisible characters, at/dot disguises,
spelled digits. What the same patterns find in the rewritten text comes back as spans of the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sectorloom.llm.common import bounded_batches, lean_arrays

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# a match never begins within a run of digits: it would have begun with the run
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digit = re.compile("[0-9]").search


def _emails(text: str) -> Iterator[Span]:
    """From each at sign outwards, as the pattern matches from the left, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _domain(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind, in code points, end exclusive."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _digit(text):
        if "." in text:
            out["ip"] = [m.span() for m in _ip(text) if all(map(_small, m[0].split(".")))]
        out["card"] = [m.span() for m in _card(text) if m.end() - m.start() >= 13 and 13 <= len(d := _only_digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _phone(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- transducers

# fixed values: characters that look like an ASCII one
HOMOGLYPHS = {
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ", "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іı", "j": "ј",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
    "@": "﹫", ".": "․。｡﹒", "-": "‐‑‒–−﹣", "+": "﹢", " ": "   ",
}
INVISIBLE = "​‌‍⁠­﻿"

_plain = {ord(c): a for a, same in HOMOGLYPHS.items() for c in same}
_plain |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full width
_plain |= {base + i: str(i) for base in (0x0660, 0x06F0, 0x0966) for i in range(10)}  # Arabic-Indic and Devanagari digits
_plain |= {ord(c): "" for c in INVISIBLE}
_odd = re.compile("[" + "".join(re.escape(chr(c)) for c in _plain) + "]")

# fixed values: digits spelled in English, German, French and Spanish; words for the at sign and the dot
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT, _DOT = "(?:at|arroba|arobase)", "(?:dot|punkt|point|punto)"
_PLUS = "(?:plus|más)"
_number = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_spelled = re.compile(rf"\b(?:{_PLUS}[ -]+)?{_number}(?:[ ,.-]+(?:{_number}|[0-9]+)\b){{6,}}", re.I)
# an octet or a digit of a longer run has a spelled neighbour
_two = re.compile(rf"\b{_number}(?:[ ,.-]+(?:{_number}|[0-9])| +{_DOT} )|[0-9](?:[ ,.-]+| +{_DOT} +){_number}\b", re.I).search
_said = re.compile(rf"{_PLUS}|{_number}|[0-9]+", re.I)
_octet = rf"(?:{_number}(?:[ -]+{_number}){{0,2}}|[0-9]{{1,3}})"
_spelled_ip = re.compile(rf"(?<!plus[ -])(?<!más[ -])(?<![0-9.])\b{_octet}(?:(?: +{_DOT} +|\.){_octet}){{3}}(?![A-Za-z0-9])", re.I)
# no octet begins within a longer run of numbers
_run = re.compile(rf"(?:\b{_number}|[0-9])[ -]{{1,3}}$", re.I).search
_point = re.compile(rf" +{_DOT} +|\.", re.I)

_bracket = re.compile(rf"[ ]?[\[({{<][ ]?({_AT}|{_DOT})[ ]?[\])}}>][ ]?", re.I)
_worded = re.compile(r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*[A-Za-z0-9])[A-Za-z0-9._%+-]+( +__AT__ +)[A-Za-z0-9-]+((?:(?: +__DOT__ +|\.)[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])".replace("__AT__", _AT).replace("__DOT__", _DOT), re.I)
# behind literal dots alone only a name counts as a domain: "at 10.30" is none
_name = re.compile(r"[A-Za-z]{2,}|xn--[A-Za-z0-9-]+", re.I).fullmatch
_worded_ip = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?: +{_DOT} +[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_mixed = re.compile(rf"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?: +{_DOT} +[A-Za-z0-9-]+)(?:(?: +{_DOT} +|\.)[A-Za-z0-9-]+)*", re.I)
_dot = re.compile(rf" +{_DOT} +", re.I)
# each of _bracket, _worded, _worded_ip and _mixed holds one of these
_disguised = re.compile(rf"[\[({{<] ?(?:{_AT}|{_DOT}) ?[\])}}>]| (?:{_AT}|{_DOT}) ", re.I).search

Edit = tuple[int, int, str]


class Tape:
    """A text and, for each of its characters, the source span that made it."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | None = None
        self.ends: list[int] | None = None

    def rewrite(self, edits: list[Edit]) -> None:
        """Replaces disjoint (start, end, by), in order; each new character stands for the whole replaced span."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for a, b, by in edits:
            text += [self.text[at:a], by]
            starts += self.starts[at:a] + [self.starts[a]] * len(by)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(by)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), starts + self.starts[at:], ends + self.ends[at:]

    def source(self, span: Span) -> Span:
        return (self.starts[span[0]], self.ends[span[1] - 1]) if self.starts is not None else span


def _homoglyphs(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), _plain[ord(m[0])]) for m in _odd.finditer(tape.text)])


def _disguises(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), "@" if m[1].lower() in ("at", "arroba", "arobase") else ".") for m in _bracket.finditer(tape.text)])
    edits: list[Edit] = []
    for m in _worded.finditer(tape.text):
        if not _dot.search(m[2]) and not _name(m[2].rpartition(".")[2]):
            continue
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _dot.finditer(tape.text, m.start(2), m.end(2))]
    tape.rewrite(edits)
    for pattern in (_worded_ip, _mixed):
        tape.rewrite([(d.start(), d.end(), ".") for m in pattern.finditer(tape.text) for d in _dot.finditer(tape.text, m.start(), m.end())])


def _octets(tape: Tape) -> None:
    edits: list[Edit] = []
    for m in _spelled_ip.finditer(tape.text):
        if _run(tape.text[max(0, m.start() - 12) : m.start()]):
            continue
        parts, at = [], m.start()
        for d in [*_point.finditer(tape.text, m.start(), m.end()), None]:
            end = d.start() if d else m.end()
            parts.append((at, end, "".join(SPELLED.get(w[0].lower(), w[0]) for w in _said.finditer(tape.text, at, end))))
            at = d.end() if d else end
        if all(_small(by) for _, _, by in parts):
            for i, (a, b, by) in enumerate(parts):
                edits += [(parts[i - 1][1], a, "."), (a, b, by)] if i else [(a, b, by)]
    tape.rewrite(edits)


def _digits(tape: Tape) -> None:
    edits: list[Edit] = []
    for m in _spelled.finditer(tape.text):
        said = list(_said.finditer(tape.text, m.start(), m.end()))
        for i, w in enumerate(said):
            end = said[i + 1].start() if i + 1 < len(said) else w.end()
            word = w[0].lower()
            edits.append((w.start(), end if i + 1 < len(said) else w.end(), "+" if word in ("plus", "más") else SPELLED.get(word, w[0])))
    tape.rewrite(edits)


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The base spans, and those with what the transducers uncover; by start, without repeats."""
    base = base_spans(text)
    tape = Tape(text)
    if _odd.search(text):
        _homoglyphs(tape)
    if _disguised(tape.text):
        _disguises(tape)
    if _two(tape.text):
        _octets(tape)
        _digits(tape)
    if tape.starts is None:
        return base, base
    more = base_spans(tape.text)
    return base, {k: sorted({*base[k], *map(tape.source, more[k])}) for k in KINDS}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with a mark of its kind for each span; overlapping spans share the mark of the first."""
    flat = sorted((a, -b, k) for k in KINDS for a, b in spans[k])
    out, at = [], 0
    for a, b, k in flat:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


FOUND = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base:string,spans:string,clean:string>"


def _found(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        base, every = all_spans(text or "")
        rows.append({f"n_{k}": len(base[k]) for k in KINDS} | {"base": joined(base), "spans": joined(every), "clean": None if text is None else redacted(text, every) if any(every.values()) else text})
    kinds = [(f"n_{k}", pa.int64()) for k in KINDS] + [(c, pa.string()) for c in ("base", "spans", "clean")]
    return pa.array(rows, pa.struct(kinds))


def find_pii(docs: DataFrame) -> DataFrame:
    """docs -> all columns and ``pii``: base counts by kind, base and all spans as text, and the redacted text.

    A null text has no spans and stays null. Repeated rows and null ids pass through; a column named
    ``pii`` is replaced. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return docs.drop("pii").withColumn("pii", arrow_udf(lean_arrays(_found), FOUND)(F.col("text").cast("string")))


def redact(docs: DataFrame) -> DataFrame:
    """docs with a mark in place of each span of personal data; n_chars, if there, follows the new text."""
    clean = find_pii(docs)
    out = clean.select(*[F.col("pii.clean").alias("text") if c == "text" else F.col(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
