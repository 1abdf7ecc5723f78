"""Extraction from texts: paragraph-aware chunks and values that follow a keyword."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words after which a value is precise.
ANCHORS = "commit table port key sha md5 hash version offset threshold size id byte line row col index revision rev tag release node pid epoch".split()
VALUE = rf"(?:^|[^A-Za-z0-9_])(?i:({'|'.join(ANCHORS)}))[ :=#]{{1,3}}(v?[0-9][0-9A-Fa-f.]*)"


def chunks(text: str, size: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size characters, broken at a blank line in their second half where there is one.

    A chunk ends at the last blank line that is within its size and beyond its half, else at its size; the next one
    begins so many characters before that end.
    """
    breaks = [m.start() + 2 for m in re.finditer(r"(?=\n\n)", text)]
    spans = [(0, 0)] if text else []
    while spans and (not spans[-1][1] or spans[-1][1] < len(text)):
        start = max(spans[-1][1] - overlap, spans[-1][0] + 1) if spans[-1][1] else 0
        full = start + size
        fit = breaks[bisect_right(breaks, full) - 1 :][:1] if breaks and full < len(text) else []
        end = fit[0] if fit and start + size // 2 + 2 < fit[0] <= full else min(full, len(text))
        spans.append((start, end))
    return spans[1:]


def chunk(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """memory_id, chunk, start, text of every chunk of every memory (memory_id, content)."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, n, a, t[a:b]) for i, t in zip(part["memory_id"], part["content"], strict=True) if t for n, (a, b) in enumerate(chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["memory_id", "chunk", "start", "text"])

    return docs.select("memory_id", "content").mapInPandas(split, "memory_id long, chunk int, start int, text string")


def values(text: Column | str) -> Column:
    """array<struct<anchor, value>> of the values that follow an anchor word."""
    whole = F.regexp_extract_all(text, F.lit(VALUE), F.lit(0))
    return F.transform(whole, lambda m: F.struct(F.lower(F.regexp_extract(m, VALUE, 1)).alias("anchor"), F.regexp_extract(m, VALUE, 2).alias("value")))
