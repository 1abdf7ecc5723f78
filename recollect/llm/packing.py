"""Concatenate and cut: tokenised documents laid end to end and cut into fixed windows.

Two passes. The first tokenises and writes ids with their offset inside their partition; partition totals (a row
for each partition) give prefix sums, hence every document's global offset. The second cuts where windows end:
a document over a border yields a record on either side. Nothing is sorted or shuffled but the totals.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.bpe import codec
from recollect.llm.common import cut, values

LENGTH = 2048  #: tokens of a sequence
END = 1  #: id that ends a document


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, ids (with the end id), n, part, at: the offset inside the partition."""

    def encode(batches):
        c, part, at = codec(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            ids = [c.encode(t or "") + tail for t in values(batch.column("text"))]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(n), pa.array([part] * len(ids), pa.int32()), pa.array(ends - n)], names=["doc_id", "ids", "n", "part", "at"])
            at = int(ends[-1]) if len(ends) else at

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary, n long, part int, at long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Every id lies in exactly one piece; every sequence but the last is full. Null texts count as empty and keep
    their end id; repeated rows are packed each; an empty table packs to no rows.
    """
    rows = cut(tokenised(docs, path, end))
    # A row for each partition of the first pass, whatever the number of documents: small enough to broadcast.
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = rows.join(F.broadcast(base), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("at")).alias("at"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def pieces(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, ids, n, at in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "ids", "n", "at")), strict=True):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    for column, value in zip(out, (doc_id, start, size, ids[4 * start : 4 * (start + size)], n, sequence, offset), strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def padding(sequence_tokens: int, length: int = LENGTH) -> int:
    """Tokens of padding behind a sequence: up to the length, none at a power of two."""
    return 0 if sequence_tokens & (sequence_tokens - 1) == 0 else length - sequence_tokens


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
