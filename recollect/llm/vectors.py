"""Vectors of an Arrow list column as padded float64 matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """The longest length; shorter vectors count as padded with zeros."""
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d components, shorter vectors padded with zeros."""
    n = len(column)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (lengths == d).all():
        return flat.reshape(n, d)
    out = np.zeros((n, d))
    rows = np.repeat(np.arange(n), lengths)
    starts = np.cumsum(lengths) - lengths
    out[rows, np.arange(len(flat)) - starts[rows]] = flat
    return out


def packed(x: np.ndarray) -> pa.Array:
    """Each row's float64 values as one binary value."""
    x = np.ascontiguousarray(x, dtype="<f8")
    width = x.shape[1] * 8
    if len(x) * width >= 1 << 31:
        raise ValueError("too many vectors in a batch")
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        parts = [unpacked(c, d) for c in column.chunks]
        return np.concatenate(parts) if parts else np.zeros((0, d))
    if not len(column) or not d:
        return np.zeros((len(column), d))
    return np.frombuffer(column.buffers()[2], dtype="<f8")[column.offset * d : (column.offset + len(column)) * d].reshape(len(column), d)
