"""Binary hypervectors: roles bound to fillers by XOR, bundled by majority, recalled by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 8192


@lru_cache(maxsize=4096)
def symbol(name: str, bits: int = BITS) -> np.ndarray:
    """The hypervector of a name: bits (0 or 1) drawn by its hash alone."""
    return np.unpackbits(np.frombuffer(b"".join(xxhash.xxh3_128_digest(f"{name}\x00{i}") for i in range(bits // 128)), dtype=np.uint8))


def bound(role: str, filler: str, bits: int = BITS) -> np.ndarray:
    return symbol(f"role:{role}", bits) ^ symbol(f"filler:{filler}", bits)


def bundle(rows: DataFrame, known: str, asked: str, bits: int = BITS) -> DataFrame:
    """bit, ones, n: the majority of every bit over all rows' bindings of two roles (columns of strings).

    Equal pairs are counted first, so a task binds each pair once; tasks add up bits, and Spark adds up tasks.
    """
    pairs = rows.where(F.col(known).isNotNull() & F.col(asked).isNotNull()).groupBy(F.col(known).alias("x"), F.col(asked).alias("y")).agg(F.count("*").alias("n"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, total = np.zeros(bits, dtype=np.int64), 0
        for batch in batches:
            for x, y, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n")), strict=True):
                ones += n * (bound(known, x, bits) ^ bound(asked, y, bits)).astype(np.int64)
                total += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(bits), pa.int32()), pa.array(ones), pa.array([total] * bits, pa.int64())], names=["bit", "ones", "n"])

    return pairs.mapInArrow(added, "bit int, ones long, n long").groupBy("bit").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))


def recall(rows: DataFrame, known: str, value: str, asked: str, bits: int = BITS) -> DataFrame:
    """filler, distance (0 to 1), support: how near each filler of the role asked for is to what the bundle gives back for a known filler.

    Unbinding leaves the filler that was bundled with it most often, among noise; unrelated ones are at a half. support is
    how often the two were bundled together.
    """
    memory = bundle(rows, known, asked, bits).agg(F.sort_array(F.collect_list(F.struct("bit", (2 * F.col("ones") > F.col("n")).cast("int").alias("one")))).alias("m"))  # bits rows
    fillers = rows.where(F.col(asked).isNotNull()).groupBy(F.col(asked).alias("filler")).agg(F.count_if(F.col(known) == value).alias("support"))
    both = fillers.join(F.broadcast(memory.select(F.col("m.one").alias("ones"))))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column("filler").to_pylist(), []
            for name, ones in zip(names, batch.column("ones").to_pylist(), strict=True):
                left = np.array(ones or [0] * bits, dtype=np.uint8) ^ bound(known, value, bits)
                out.append(float(np.count_nonzero(left ^ bound(asked, name, bits))) / bits)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.float64()), batch.column("support")], names=["filler", "distance", "support"])

    return both.mapInArrow(compared, "filler string, distance double, support long")
