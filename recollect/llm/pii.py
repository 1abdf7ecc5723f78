"""Personal data in whole texts: plain patterns, and disguised ones by offset-preserving normalisation.

Two kinds of spans are found. The base ones are matches of four patterns in the text as it is. The others come from
transducers that rewrite look-alike characters, spelled digits and at/dot disguises while they keep, for every
character written, the source characters it stands for; the same patterns are then matched in the rewritten text and
their spans mapped back. A found span counts if a rewriting lies in it and no base span of its kind contains it; it
may overlap one that holds only a part of the same identifier.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.llm.common import values

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # index of the kind, start, end (code points, end exclusive)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A run of digits that fails to match fails from each of its digits, so only its start is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the local part, @ and domain, leftmost and non-overlapping, in linear time: from each @ both ways."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, sorted by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# Letters of other scripts that look like ASCII ones; other forms of ASCII characters follow by NFKC.
_LOOK_ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_INVISIBLE = frozenset("­​‌‍⁠﻿")
# Names of the digits, and words for at, dot and plus, in English, German, French and Spanish.
_DIGIT_NAMES = (
    "zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
    "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
)
_SPELLED = {name: str(digit) for digit, names in enumerate(_DIGIT_NAMES) for name in names.split()}
_AT_NAMES, _DOT_NAMES = "at|arroba|arobase|ät", "dot|point|punkt|punto"
_NAMES = "|".join(_SPELLED)
# Three names at least, with what separates them; a word for a dot may stand between two.
_SPELLED_RUN = re.compile(rf"\b(?:(?P<plus>plus|más)[\s-]+)?(?:(?:{_NAMES})\b(?:[\s,-]{{1,3}}|\s+(?:{_DOT_NAMES})\s+)){{2,}}(?:{_NAMES})\b")
_NAME = re.compile(rf"\b(?:{_NAMES}|{_DOT_NAMES})\b")
_AT = re.compile(
    rf"\s*[\[({{<]\s*(?:{_AT_NAMES}|@)\s*[\])}}>]\s*|(?<=[a-z0-9])(?P<plain>\s+at\s+)(?=[a-z0-9-]+(?:(?P<dot>\s*\.\s*)|\s+(?:{_DOT_NAMES})\s+|\s*[\[({{<]\s*(?:{_DOT_NAMES}|\.)\s*[\])}}>]\s*)[a-z0-9])"
    r"|(?<=[a-z0-9])\s+(?:arroba|arobase)\s+(?=[a-z0-9])|(?<=[a-z0-9])_at_(?=[a-z0-9])|&#64;|&commat;|%40(?=[a-z0-9])"
)
# "at" before a plain domain is prose ("we met at example.com") unless the name before it has a sign or a digit, as addresses
# have, or the words before it speak of an address.
_CUE = re.compile(
    r"\b(?:e-?mails?|mail(?:to)?|write|contact|reach|address|send|ping|cc|bcc|schreib\w*|adresse|kontakt|erreich\w*|écri\w*|courriel|contacte\w*|correo|escrib\w*|contacta\w*|dirección)\b[\s:,;-]*"
    r"(?:(?:to|is|me|us|him|her|them|via|the|my|our|address|an|bitte|mir|uns|ist|à|est|moi|nous|a|al|es|mi|por|adresse|dirección)\b[\s:,;-]*){0,3}\Z"
)
_NO_NAME = frozenset("i me you he him she her it us we they them this that is are was were be been look met all or and not only".split())
_DOT = re.compile(rf"\s*[\[({{<]\s*(?:{_DOT_NAMES}|\.)\s*[\])}}>]\s*|(?<=[a-z0-9])\s+dot\s+(?=[a-z0-9])|(?<=[a-z0-9])\s+(?:point|punkt|punto)\s+(?=[a-z]{{2,6}}\b)|(?<=[a-z0-9])_dot_(?=[a-z0-9])|&#46;")
# Without the white space that _AT and _DOT take before and after it: whatever they match holds a match of these.
_AT_WORD = re.compile(rf"\s(?:at\s+[a-z0-9-]+(?:\s*[.\[({{<]|\s+(?:{_DOT_NAMES})\s)|(?:arroba|arobase)\s)")
_DOT_WORD = re.compile(rf"\s(?:{_DOT_NAMES})\s")
_BRACKET = re.compile(rf"[\[({{<]\s*(?:{_AT_NAMES}|@|{_DOT_NAMES}|\.)\s*[\])}}>]")
_MARKED = re.compile(r"[0-9._%+-]")


@lru_cache(maxsize=1 << 16)
def _plain(c: str) -> str:
    """What a character stands for: itself, an ASCII look-alike, or nothing if it is invisible."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOK_ALIKE:
        return _LOOK_ALIKE[c]
    if ord(c) >= 0x2000 and len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii():
        return n
    if c.isdecimal() and not c.isascii():
        return str(unicodedata.decimal(c))
    return c


class Tape:
    """A text with, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)
        self.edits: list[int] = []  # source offsets where something was rewritten

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace the stretches (start, end, with what), in order and apart; the new characters share the source."""
        if not changes:
            return
        out: list[str] = []
        start: list[int] = []
        end: list[int] = []
        at = 0
        for a, b, new in changes:
            out += [self.text[at:a], new]
            start += self.start[at:a]
            end += self.end[at:a]
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            self.edits.append(self.start[a])
            at = b
        out.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(out), start, end


def _characters(text: str) -> list[tuple[int, int, str]]:
    return [(i, i + 1, new) for i, c in enumerate(text) if c > "\x7f" and (new := _plain(c)) != c]


def _digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits, each written as digits, with points for the words for a dot and without what else stood between them."""
    names = lambda m: _NAME.findall(text, m.end("plus") if m["plus"] else m.start(), m.end())
    return [(m.start(), m.end(), "+" * bool(m["plus"]) + "".join(_SPELLED.get(x, ".") for x in names(m))) for m in _SPELLED_RUN.finditer(text)]


def _lower(text: str) -> str:
    """Lower case, code point for code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _ats(text: str) -> list[tuple[int, int, str]]:
    """What stands for @ in a text in lower case."""
    out = []
    for m in _AT.finditer(text):
        if m["plain"] and m["dot"]:
            start = m.start()
            while start and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            name = text[start : m.start()]
            if name in _NO_NAME or not (_MARKED.search(name.strip("._-")) or _CUE.search(text, max(0, start - 60), start)):
                continue
        out.append((m.start(), m.end(), "@"))
    return out


def _dots(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in _DOT.finditer(text)]


def disguised(text: str) -> bool:
    """Whether any transducer may have something to rewrite: never false where one has."""
    if not text.isascii() and any(_plain(c) != c for c in set(text) if c > "\x7f"):
        return True
    low = _lower(text)
    if "&#" in low or "%40" in low or "&commat" in low or "_at_" in low or "_dot_" in low:
        return True
    return bool(_DOT_WORD.search(low) or _AT_WORD.search(low) or _BRACKET.search(low) or _SPELLED_RUN.search(low))


def spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each sorted by kind and start."""
    text = text or ""
    base = base_spans(text)
    if not disguised(text):
        return base, base
    tape = Tape(text)
    tape.rewrite(_characters(tape.text))
    tape.rewrite(_digits(_lower(tape.text)))
    for found in (_ats, _dots):
        tape.rewrite(found(_lower(tape.text)))
    edits = sorted(tape.edits)
    by_kind = [[(a, b) for k, a, b in base if k == kind] for kind in range(len(KINDS))]
    more = []
    for kind, a, b in base_spans(tape.text):
        if kind == 0 and not tape.text[a:b].rpartition(".")[2][:2].isalpha():
            continue
        start, end = tape.start[a], tape.end[b - 1]
        i = bisect_left(edits, start)
        if i == len(edits) or edits[i] >= end:
            continue
        near = bisect_left(by_kind[kind], (start + 1,)) - 1  # base spans of a kind are apart, so the last that starts no later tells
        if near >= 0 and by_kind[kind][near][1] >= end:
            continue
        more.append((kind, start, end))
    return base, sorted([*base, *more]) if more else base


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row; a null text is empty.

    Rows that repeat an id or a text are each told. Time and memory grow in proportion to a text's length.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def found(batches):
        for batch in batches:
            rows = [spans(t) for t in values(batch.column("text"))]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in range(len(KINDS))]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *counts, pa.array(digests, pa.string()), pa.array([written(s) for _, s in rows], pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with a mark in place of every span; overlapping spans become one mark."""
    if not text:
        return text
    found = sorted((a, b, k) for k, a, b in spans(text)[1])
    if not found:
        return text
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by marks; a column n_chars follows the new length."""

    def redacted(batches):
        for batch in batches:
            texts = [masked(t) for t in values(batch.column("text"))]
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], schema=batch.schema)

    return docs.mapInArrow(redacted, docs.schema)
