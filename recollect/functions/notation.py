"""Distilled notation: typed learnings, facts and their annotations, line by line, as a table function.

A marker line opens a learning; verbatim lines, citations and plain lines below it belong to it. Arrows within a
learning's lines are facts. A line that fits nowhere is told as broken, with its number, rather than dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import dates

# Markers of learnings with their category, and the patterns of annotations.
CATEGORIES = {
    "SOLUTION": "solution", "GOTCHA": "gotcha", "DECISION": "decision", "PATTERN": "pattern", "PREFERENCE": "preference", "BELIEF": "belief", "INSIGHT": "wisdom",
    "FAILURE": "failure", "AFFECT": "affect", "CORRECTION": "correction", "EVENT": "event", "OPERATIONAL": "operational",
}
AFFECT = re.compile(r"A:([+-]?\d+\.?\d*),(\d+\.?\d*)|valence:\s*([+-]?\d+\.?\d*)\s*,\s*arousal:\s*(\d+\.?\d*)")
FLAGS = re.compile(r"F:([A-Z_,]+)")
REF = re.compile(r"→@([a-zA-Z0-9_-]+)")
ANNOTATIONS = re.compile(r"\s*(?:A:[+-]?\d+\.?\d*,\d+\.?\d*|F:[A-Z_,]+|→@[a-zA-Z0-9_-]+)")
CITED = re.compile(r"@([\w./-]+(?:\.\w+)?):?(\d*)")
CITE_LINE = re.compile(r"\[CITE\]\s+([\w./-]+(?:\.\w+)?):?(\d*)\s*(.*)")
FACT = re.compile(r"\[TRIPLET\]\s+(\S+)\s+(\S+)\s+(.+)")
DATED = re.compile(r"(.*?)\s*@(\d{4}-\d{2}-\d{2}|yesterday|today|last\s+\d*\s*(?:day|week|month|year)s?)", re.IGNORECASE)
ARROW = re.compile(r"\$?\s*\\rightarrow\s*\$?|->|=>")
PREDICATES = {"GOTCHA": "causes"}  #: of a learning's arrows; leads_to for other types
TITLE = 100  #: characters of a title

_MARKER = re.compile(rf"\[({'|'.join(CATEGORIES)})\]\s+(.*)")
SCHEMA = (
    "line int, kind string, type string, category string, title string, content string, subject string, predicate string, object string, said string, "
    "valence double, arousal double, flags array<string>, refs array<string>, citations array<struct<file:string,line:int,context:string>>"
)
_EMPTY = (None,) * 15


@dataclass
class Learning:
    line: int
    type: str
    lines: list[tuple[int, str]] = field(default_factory=list)
    cited: list[tuple[str, int, str]] = field(default_factory=list)


def _plain(text: str) -> str:
    return ANNOTATIONS.sub("", text).rstrip()


def _entities(part: str) -> list[str]:
    """A name, or the names within braces; none where something is missing."""
    part = part.strip()
    if not part.startswith("{"):
        return [part] if part else []
    names = [x.strip() for x in part[1:-1].split(",")] if part.endswith("}") and len(part) > 1 else [""]
    return names if all(names) else []


def _fact(line: int, subject: str, predicate: str, object_: str) -> Iterator[tuple]:
    dated = DATED.fullmatch(object_)
    object_, said = (dated[1].rstrip(), dated[2]) if dated else (object_, None)
    if object_:
        yield (line, "triplet", *_EMPTY[:4], subject, predicate, object_, said, *_EMPTY[:5])


def _facts(learning: Learning) -> Iterator[tuple]:
    for number, text in learning.lines:
        if text.lstrip().startswith("[ε]"):
            continue
        chain = re.sub(r"^\[[^\]]*\]\s*", "", _plain(ARROW.sub("→", text.strip())).strip())
        predicate = PREDICATES.get(learning.type, "leads_to")
        if learning.type == "DECISION" and "|" in chain:
            predicate, chain = "chosen_over", chain.split("|")[0]
            chain = chain if "→" in chain else chain.replace(">", "→", 1)
        stations = [_entities(x) for x in chain.split("→")]
        if len(stations) > 1 and all(stations):
            for here, there in zip(stations, stations[1:]):
                for subject in here:
                    for object_ in there:
                        yield from _fact(number, subject, predicate, object_)


def _number(digits: str) -> int:
    return int(digits) if digits and len(digits) < 10 else 0


def _closed(learning: Learning) -> Iterator[tuple]:
    whole = "\n".join(text for _, text in learning.lines)
    if not whole.strip():
        yield (learning.line, "broken", learning.type, *_EMPTY[:2], f"[{learning.type}]", *_EMPTY[:9])
        return
    content = _plain(whole)
    affect = AFFECT.search(whole)
    valence, arousal = (float(affect[1] or affect[3]), float(affect[2] or affect[4])) if affect else (0.0, 0.0)
    flags = FLAGS.search(whole)
    cited = list(learning.cited)
    for m in CITED.finditer(whole):
        if (m[1], _number(m[2])) not in [c[:2] for c in cited]:
            cited.append((m[1], _number(m[2]), ""))
    yield (
        learning.line, "learning", learning.type, CATEGORIES[learning.type], content.split("\n")[0][:TITLE], content, *_EMPTY[:4], max(-1.0, min(1.0, valence)), min(1.0, arousal),
        [f for f in flags[1].split(",") if f] if flags else [], REF.findall(whole), cited,
    )
    yield from _facts(learning)


def parse(text: str | None) -> Iterator[tuple]:
    """Rows of SCHEMA for a text, each with its line; none for a null one. Fences, rules and blank lines say nothing."""
    held: Learning | None = None
    for number, line in enumerate((text or "").split("\n"), 1):
        line = line.rstrip("\r")
        if not line or line.startswith("```") or line == "---":
            continue
        marker, fact, cite = _MARKER.fullmatch(line), FACT.fullmatch(line), CITE_LINE.fullmatch(line)
        if marker or fact:
            if held:
                yield from _closed(held)
            held = Learning(number, marker[1], [(number, marker[2])]) if marker else None
            if fact:
                yield from _fact(number, fact[1], fact[2], _plain(fact[3]).strip())
        elif held and cite:
            held.cited.append((cite[1], _number(cite[2]), cite[3].rstrip()))
        elif held and (line.startswith("[ε]") or not line.startswith("[")):
            held.lines.append((number, line))
        else:
            yield (number, "broken", *_EMPTY[:3], line, *_EMPTY[:9])
    if held:
        yield from _closed(held)


@F.udtf(returnType=SCHEMA)
class Notation:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from parse(text)


def parsed(docs: DataFrame, text: str = "text", anchor: Column | None = None) -> DataFrame:
    """The columns of docs with a row for everything that parse() finds in their text; rows without any are left out.

    valid_from (microseconds) is what a fact's date means at the anchor; null without a date or an anchor.
    """
    rows = docs.lateralJoin(Notation(F.col(text).outer()))
    at = dates.resolve(F.col("said"), anchor)["at"] if anchor is not None else F.lit(None).cast("long")
    return rows.withColumn("valid_from", at)


def is_notation(text: Column) -> Column:
    """Whether a text opens with something in brackets, or holds an arrow or a grain from 0 to 4."""
    return (text.startswith("[") & text.contains("]")) | text.contains("→") | text.rlike(" G:[0-4]")


def bracketed(text: Column, domain: str = "note", location: Column | None = None) -> Column:
    """A text in brackets with its place, unless it is in the notation: titles are a first line under 80 characters, or else 80 characters."""
    at = F.lit("") if location is None else F.when(F.coalesce(location, F.lit("")) != "", F.concat(F.lit(" @"), location)).otherwise("")
    line = F.substring_index(text, "\n", 1)
    short = text.contains("\n") & (F.length(line) < 80)
    title = F.when(short, line).when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("..."))).otherwise(text)
    rest = F.when(short, F.concat(F.lit("\n"), F.substring(text, F.length(line) + 2, F.length(text)))).when(F.length(text) > 80, F.concat(F.lit("\n"), text)).otherwise("")
    return F.when(is_notation(text), text).otherwise(F.concat(F.lit(f"[{domain}] "), title, at, rest))
