"""Text functions as column expressions: tokens, query expansion, speech acts, intents, token estimates."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that are no tokens.
LEX_STOP = ["the", "and", "for", "with", "what", "how", "did", "does", "was", "were", "are", "that", "this", "when", "where", "who", "why"]
# Words that query expansion drops.
EXPAND_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from "
    "as into through i me my we our you your he him his she her it its they them their what which who this that these those not only just about so "
    "than too very all both each more most other some such no own same here there when where why how then once am out off over under"
).split()
# Words that are no terms of a query, and words that name nothing in code.
TERM_STOP = "the and for that with how what does can".split()
CODE_STOP = "the and for with what which where how does this that from are when into can code file function implemented implements".split()
# Speech acts in order, the first that matches counts.
SPEECH_ACTS = [
    ("decision", r"\bwe\s+decided\b|\bdecision\s*:|\bchose\b.{0,40}\bover\b|\bgoing\s+with\b"),
    ("correction", r"\bactually\b.{0,40}\bshould\b|\bcorrect(?:ion)?\s*:|\bwas\s+wrong\b|\bmistake\b"),
    ("preference", r"\bI\s+prefer\b|\bI(?:'d| would)\s+rather\b|\bprefer(?:ence)?\s*:|\bfavou?r(?:ite)?\b"),
    ("task", r"\bTODO\b|\bnext\s+step\b|\bwe\s+need\s+to\b|\baction\s+item\b|\btask\s*:"),
    ("result", r"\bworks?\s+now\b|\bfixed\b|[A-Za-z0-9_]✓[A-Za-z0-9_]|\bsolved\b|\bcompleted\b|\bsuccessfully\b"),
    ("failure", r"\bfailed?\b|\berror\s*:|\bcrash(?:ed)?\b|\bdoes\s+not\s+work\b|\bbroken\b"),
    ("question", r"\bwhy\b.{0,60}\?|\bhow\s+does\b|\bwhat\s+is\b|\bwhere\s+is\b|\bwhen\s+did\b"),
    ("hypothesis", r"\bhypothes[ie]s\b|\bassume\b|\bperhaps\b|\bmaybe\b.{0,40}\bif\b|\bconjecture\b"),
]
# Temporal questions in order, by phrases they contain.
TEMPORAL = [
    ("when", ["when did", "when was", "when is", "what date", "what day"]),
    ("first_last", ["first time", "last time", "most recent", "earliest", "latest"]),
    ("duration", ["how long", "for how many", "since when", "how many years", "how many months", "how many days"]),
    ("sequence", ["before", "after", "what happened", "sequence", "timeline", "in order"]),
    ("as_of", ["as of", "at that time", "back then"]),
]
# Fixed value: months and years that a question may look back to.
MONTHS = r"in\s+(january|february|march|april|may|june|july|august|september|october|november|december|20[0-9]{2})"
# Question words that name no entity.
QUESTION_WORDS = "When What Where Who How Why Which Would Could Should Did Does Is Are Was Were Has Have Had Do Can Will".split()


def lex_tokens(text: Column | str) -> Column:
    """Distinct lower-case tokens of ASCII letters, digits, - and _, with the parts of glued ones; 3 characters at least."""
    low = F.lower(text)
    # The parts of a token between - and _ are the runs of letters and digits; runs of fewer than 3 never match.
    glued, parts = (F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in ("[a-z0-9_-]{3,}", "[a-z0-9]{3,}"))
    return F.array_except(F.array_union(glued, parts), F.array(*map(F.lit, LEX_STOP)))


def python_lex_tokens(text: str) -> list[str]:
    """lex_tokens of a query text, sorted."""
    glued = re.findall("[a-z0-9_-]+", text.lower())
    parts = [p for t in glued for p in re.split("[-_]", t)]
    return sorted({t for t in [*glued, *parts] if len(t) >= 3 and t not in LEX_STOP})


def words(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def python_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def expand(text: Column) -> Column:
    """The lexical variant of a query: its words without signs and stop words, or the query itself if none is left."""
    plain = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    kept = F.filter(plain, lambda w: (w != "") & ~w.isin(EXPAND_STOP))
    return F.when(F.size(kept) == 0, text).otherwise(F.array_join(kept, " "))


def speech_act(text: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(SPEECH_ACTS):
        found = F.when(text.rlike(f"(?i){pattern}"), kind).otherwise(found)
    return found


def temporal_subtype(text: Column) -> Column:
    low, found = F.lower(text), F.lit("none")
    for kind, phrases in reversed(TEMPORAL):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        if kind == "as_of":
            hit = hit | low.rlike(MONTHS)
        found = F.when(hit, kind).otherwise(found)
    return found


def entities(text: Column) -> Column:
    """Capitalised ASCII words that aren't question words, in order of their first occurrence."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z][a-z]+)(?=[^A-Za-z0-9_]|$)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, QUESTION_WORDS)))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, as a whole number."""
    return F.floor(F.regexp_count(text, F.lit(r"\S+")) * F.lit(1.3)).cast("long")


def extract_terms(text: Column) -> Column:
    """The terms of a query in their order: its words without signs, lower-case, of 3 ASCII letters or digits at least."""
    plain = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", "")))
    return F.filter(plain, lambda w: (F.length(w) >= 3) & ~w.isin(TERM_STOP))


def code_words(text: Column) -> Column:
    """Words of identifiers in their order: parted at humps and between letters and digits, lower-case, lightly stemmed."""
    parted = F.regexp_replace(text, "([a-z])(?=[A-Z])|([A-Za-z])(?=[0-9])|([0-9])(?=[A-Za-z])", "$1$2$3 ")
    kept = F.filter(F.transform(F.split(parted, "[^A-Za-z0-9]+"), F.lower), lambda w: (F.length(w) > 1) & ~w.isin(CODE_STOP))
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)

    def stem(w: Column) -> Column:
        n = F.length(w)
        return F.when((n > 5) & w.endswith("ing"), cut(w, 3)).when((n > 4) & w.endswith("ed"), cut(w, 2)).when((n > 4) & w.endswith("s"), cut(w, 1)).otherwise(w)

    return F.transform(F.transform(kept, stem), lambda w: F.when((F.length(w) > 4) & w.endswith("e"), cut(w, 1)).otherwise(w))


def _shared_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """token_f1() of lower-case texts; a text's words are counted once."""

    def f1(x: str | None, y: str | None) -> float:
        left, right = Counter(python_words(x or "")), Counter(python_words(y or ""))
        common = sum(min(n, right[w]) for w, n in left.items() if w in right)
        return 2.0 * common / (left.total() + right.total()) if common else 0.0

    return pd.Series([f1(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_f1(a: Column | str, b: Column | str) -> Column:
    """Harmonic mean of the shares of two texts' words that the other has, each as often as it has it; 0 without any in common."""
    return F.pandas_udf(_shared_words, DoubleType())(F.lower(a), F.lower(b))
