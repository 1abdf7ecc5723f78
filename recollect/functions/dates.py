"""Dates in words as column expressions: relative and absolute forms against an anchor, and the annotations of texts.

Times are microseconds since 1970 in UTC, so no session's time zone shifts them. A resolved expression is a half-open interval:
the last N units end at the anchor, anything else is the day it falls on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000  #: microseconds of a day
FAR = 700_000  #: days back, beyond which nothing is resolved

# Days of a unit, and the names of months with their short forms.
UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
MONTHS = "january february march april may june july august september october november december".split()

_UNIT = "(day|week|month|year)"
_RELATIVE = rf"yesterday|today|last\s+\w+|\d+\s+{_UNIT}s?\s+ago"
_LAST_N, _LAST, _AGO = rf"last\s+(\d+)\s+{_UNIT}s?", r"last\s+(week|month|year)", rf"(\d+)\s+{_UNIT}s?\s+ago"
_YMD, _DMY, _MDY, _PLAIN = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})[-/](\w+)[-/](\d{4})$", r"^(\w+)\s+(\d{1,2}),?\s*(\d{4})$", r"^(\d{4})(\d{2})(\d{2})$"
_NAMES = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
_ANNOTATED = rf"(?i)@(\d{{4}}-\d{{2}}-\d{{2}}|yesterday|today|last\s+\d*\s*{_UNIT}s?|\d+\s+{_UNIT}s?\s+ago)"
_MENTIONED = (
    rf"(?i)(?<![\w-])(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[-/](?:{_NAMES})[-/]\d{{4}}|(?:{_NAMES})\s+\d{{1,2}},?\s+\d{{4}}"
    rf"|yesterday|today|last\s+\d+\s+{_UNIT}s?|last\s+(?:week|month|year)|\d+\s+{_UNIT}s?\s+ago)(?![\w-])"
)


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _number_of(names: dict[str, int], name: Column) -> Column:
    """What a name stands for; null for one that isn't there."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), name)


def _month(name: Column) -> Column:
    """1 to 12 of an English month or its short form, null otherwise."""
    return _number_of({n: i for i, m in enumerate(MONTHS, 1) for n in (m, m[:3])}, name)


def _midnight(year: Column, month: Column, day: Column) -> Column:
    """Microseconds of a day's beginning; null where the calendar has no such day."""
    date = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(month.isNotNull() & year.isNotNull() & day.isNotNull(), F.unix_date(date).cast("long") * DAY)


def absolute(text: Column) -> Column:
    """Microseconds of 2024-01-15, 15-Jan-2024, 15/January/2024, Jan 15, 2024 or 20240115, whole; null for all else."""
    low = F.lower(F.trim(text))
    forms = [(_YMD, 1, 2, 3), (_PLAIN, 1, 2, 3), (_DMY, 3, 2, 1), (_MDY, 3, 1, 2)]

    def part(k: int) -> Column:
        found = F.lit(None).cast("string")
        for form in reversed(forms):
            found = F.when(low.rlike(form[0]), F.regexp_extract(low, form[0], form[k])).otherwise(found)
        return found

    month = F.when(low.rlike(_YMD) | low.rlike(_PLAIN), _number(part(2))).otherwise(_month(part(2)))
    return _midnight(_number(part(1)), month, _number(part(3)))


def _days(low: Column, pattern: str, n: int | None, unit: int) -> Column:
    size = _number_of(UNITS, F.regexp_extract(low, pattern, unit)).cast("long")
    found = size * (F.lit(1) if n is None else _number(F.regexp_extract(low, pattern, n)))
    return F.when(found <= FAR, found)


def resolve(text: Column, anchor: Column) -> Column:
    """struct<at, start, until, approximate> of an expression said at anchor (microseconds); null where it is no date.

    Months have 30 days and years 365. A text that holds a relative form anywhere is read as one: "yesterday" and "today"
    stand alone, the others may stand within it.
    """
    low = F.lower(F.trim(text))
    back = F.when(low == "yesterday", F.lit(1)).when(low == "today", 0).when(low.rlike(_LAST_N), _days(low, _LAST_N, 1, 2)).when(low.rlike(_LAST), _days(low, _LAST, None, 1)).when(low.rlike(_AGO), _days(low, _AGO, 1, 2))
    relative = low.rlike(_RELATIVE)
    at = F.when(relative, anchor - back * DAY).otherwise(absolute(text))
    ranged = relative & ~low.isin("yesterday", "today") & (low.rlike(_LAST_N) | low.rlike(_LAST))
    # The time is worked out once, and the rest from it.
    one = lambda x: F.struct(x.alias("at"), F.when(ranged, x).otherwise(x - F.pmod(x, F.lit(DAY))).alias("start"), F.when(ranged, anchor).otherwise(x - F.pmod(x, F.lit(DAY)) + DAY).alias("until"), (relative & (low != "today")).alias("approximate"))
    return F.get(F.transform(F.filter(F.array(at), lambda x: x.isNotNull()), one), F.lit(0))


def annotation(text: Column) -> Column:
    """The first @date of a text, without its sign; null if there is none."""
    found = F.regexp_extract(text, _ANNOTATED, 1)
    return F.when(found != "", found)


def mention(text: Column) -> Column:
    """The first date in words or digits that a text mentions; null if there is none."""
    found = F.regexp_extract(text, _MENTIONED, 1)
    return F.when(found != "", found)
