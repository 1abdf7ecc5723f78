"""Vectors that are alike: pairs from an index of random hyperplanes, and greedy matching of the most alike."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.graph import settled, unsettle
from recollect.operators.vector import cosine

MISSED = 0.02  #: share of pairs at the threshold that may be missed
PER_KEY = 32  #: vectors that a key of the index has, about
SIEVE, SPREAD = 128, 5.5  #: signs of a vector that are compared where keys meet, and how many deviations beyond their mean may differ
AT_ONCE = 1024  #: vectors of a batch whose keys are made at once


def tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, number of tables) for n vectors: so many that a pair at the threshold shares a key but rarely."""
    bits = max(1, math.ceil(math.log2(max(2, n) / PER_KEY)))
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return bits, max(1, math.ceil(math.log(MISSED) / math.log1p(-min(same**bits, 1 - 1e-12))))


def _fit(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of vectors that are neither null nor zero nor hold null or non-finite components."""
    return vectors.where("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def keyed(good: DataFrame, threshold: float) -> DataFrame:
    """vec_id, s0, s1 (SIEVE signs), keys (one a table)."""
    n = good.count()
    sizes = [r.dims for r in good.select(F.size("embedding").alias("dims")).distinct().collect()]  # one, or as many as there are kinds of vectors
    bits, many = tables(n, threshold)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {d: np.random.default_rng(d).standard_normal((d, bits * many + SIEVE)) for d in sizes}
        powers = (1 << np.arange(bits, dtype=np.int64))[None, None, :]
        for whole in batches:
            for first in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(first, AT_ONCE)
                rows = batch.column("embedding").to_pylist()
                out, signs = np.zeros((len(rows), many), dtype=np.int64), np.zeros((len(rows), SIEVE // 64), dtype=np.int64)
                for d in {len(r) for r in rows}:
                    at = [i for i, r in enumerate(rows) if len(r) == d]
                    sign = np.array([rows[i] for i in at]) @ planes[d] > 0
                    out[at] = (sign[:, : bits * many].reshape(len(at), many, bits) * powers).sum(axis=2) + (np.arange(many, dtype=np.int64) << bits)[None, :]
                    signs[at] = np.packbits(sign[:, bits * many :], axis=1).view(np.int64)
                ends = pa.array(np.arange(0, out.size + 1, many, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(np.ascontiguousarray(x)) for x in signs.T), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["vec_id", "s0", "s1", "keys"])

    return good.mapInArrow(keys, "vec_id long, s0 long, s1 long, keys array<long>")


def candidates(good: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b, each once) of vectors that share a key of the index and differ in no more signs than pairs at the threshold do.

    Signs of a pair at the threshold differ independently; SPREAD deviations beyond their mean lose about one pair in ten million.
    """
    differ = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    most = math.ceil(SIEVE * differ + SPREAD * math.sqrt(SIEVE * differ * (1 - differ)))
    held = keyed(good, threshold).select("vec_id", "s0", "s1", F.explode("keys").alias("key"))
    l, r = held.alias("l"), held.alias("r")
    signs = sum((F.bit_count(F.col(f"l.{s}").bitwiseXOR(F.col(f"r.{s}"))) for s in ("s0", "s1")), F.lit(0))
    pairs = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.vec_id") < F.col("r.vec_id")) & (signs <= most))
    return pairs.select(F.col("l.vec_id").alias("a"), F.col("r.vec_id").alias("b")).distinct()


def near_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b, score of the pairs (a < b) with a cosine at the threshold or above that share a key of the index.

    The index has about PER_KEY vectors a key and finds all but MISSED of the pairs at the threshold, more above it. Pairs are told by
    their signs where keys meet, so hardly any but those at the threshold are dealt out again and compared. A group of
    near copies gives all its pairs, as that is what is asked for; consolidate() is what takes such groups apart.
    """
    good = _fit(vectors)
    pairs = settled(candidates(good, threshold))
    x = good.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    y = good.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    scored = pairs.join(x, "a").join(y, "b").select("a", "b", cosine("x", "y").alias("s"))
    return scored.where(F.col("s") >= threshold).select("a", "b", F.round("s", 6).alias("score"))


def consolidate(pairs: DataFrame) -> DataFrame:
    """a, b, score, round of the pairs that greedy matching by descending score takes (ties by a, then b); nobody is taken twice.

    A pair that is the best of both its ends is one that greedy matching takes, whatever else there is. So each round takes all of
    these at once and drops what they touch; the result is that of going through all pairs one after the other.
    """
    left = settled(pairs.select("a", "b", "score"))
    taken, number = None, 0
    while not left.isEmpty():
        number += 1
        order = F.struct(F.col("score"), (-F.col("a")).alias("first"), (-F.col("b")).alias("second"))
        ends = left.select(F.col("a").alias("id"), order.alias("o")).unionByName(left.select(F.col("b").alias("id"), order.alias("o")))
        best = ends.groupBy("id").agg(F.max("o").alias("o")).select("id", F.col("o.score").alias("score"), (-F.col("o.first")).alias("a"), (-F.col("o.second")).alias("b"))
        chosen = settled(best.groupBy("a", "b", "score").agg(F.count("*").alias("n")).where("n = 2").select("a", "b", "score", F.lit(number).alias("round")))
        taken = chosen if taken is None else taken.unionByName(chosen)
        gone = chosen.select(F.col("a").alias("id")).unionByName(chosen.select(F.col("b").alias("id")))
        former, left = left, settled(left.join(gone, F.col("a") == F.col("id"), "left_anti").join(gone, F.col("b") == F.col("id"), "left_anti"))
        unsettle(former)
    return taken if taken is not None else pairs.select("a", "b", "score", F.lit(0).alias("round")).limit(0)
