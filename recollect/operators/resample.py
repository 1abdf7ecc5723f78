"""Bootstrap intervals in one pass: every row counts in each resample as often as a Poisson draw by its hash says."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit thresholds of a Poisson variable of mean 1: a draw at or above the k-th counts k + 1 times or more.
_STEPS = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(keys: np.ndarray, resamples: int, seed: int = 0) -> np.ndarray:
    """How often each key (64-bit) counts in each resample; the same for the same key, whatever task it is in."""
    base = _mixed(keys.astype(np.uint64) + np.uint64(seed))[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    drawn = (_mixed(base) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_STEPS, drawn, side="right")


def intervals(rows: DataFrame, group: str, key: str, value: str, resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """group, n, mean, lo, hi: the mean of each group with its bootstrap interval; null values don't count.

    A task adds up the resamples of its rows; Spark adds up tasks, so a group of any size costs a task so many numbers.
    """
    kind = dict(rows.dtypes)[group]
    fit = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.xxhash64(key).alias("key"), F.col(value).cast("double").alias("x"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            codes = batch.column("g").dictionary_encode()
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            keys, x = batch.column("key").to_numpy().view(np.uint64), batch.column("x").to_numpy()
            for i, name in enumerate(names):
                for part in np.array_split(np.flatnonzero(at == i), max(1, (at == i).sum() // 4096 + 1)):
                    w = weights(keys[part], resamples, seed)
                    own = held.setdefault(name, [np.zeros(resamples), np.zeros(resamples)])
                    own[0] += x[part] @ w
                    own[1] += w.sum(axis=0)
        for name, (total, count) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * resamples, batch.schema.field("g").type), pa.array(range(resamples), pa.int32()), pa.array(total), pa.array(count)], names=["g", "resample", "total", "count"])

    sums = fit.mapInArrow(added, f"g {kind}, resample int, total double, count double").groupBy("g", "resample").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    means = sums.where("count > 0").groupBy("g").agg(F.sort_array(F.collect_list(F.col("total") / F.col("count"))).alias("m"))
    low = F.floor(F.size("m") * F.lit((1 - level) / 2)).cast("int")
    plain = fit.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return plain.join(means, "g").select(F.col("g").alias(group), "n", "mean", F.element_at("m", low + 1).alias("lo"), F.element_at("m", F.greatest(F.lit(1), F.size("m") - low)).alias("hi"))
