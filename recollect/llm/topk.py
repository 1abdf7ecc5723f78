"""Exact top-k inner-product search by MaxScore over shards.

Every dimension is a query term whose postings are the shard's components in it, held column by column. A term's
bound is the most it can add in the shard. Terms are sorted by bound; those whose bounds together stay below the
k-th best score known so far are non-essential, for a vector that gets nothing from the essential ones cannot reach
it. Essential postings are traversed for the whole shard, the others probed a few terms at a time and only for
vectors whose score plus the bounds still open is competitive. The shards' best are merged by one ranked window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.vectors import dimension, matrix, packed, unpacked, usable

SHARD = 65_536  #: vectors of a shard, or queries of a block, at most on average
SEED = 512  #: vectors of a shard scored in full at first, for a first k-th best
PROBE = 6  #: non-essential terms probed between two tests


def maxscore(q: np.ndarray, own: int, columns: np.ndarray, ids: np.ndarray, top: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, scores) of every vector that may be among the k best for q; ids equal to own take no part."""
    n = len(ids)
    bound = np.maximum(q * top, q * low)
    order = np.argsort(-bound, kind="stable")
    best = q @ columns[:, :SEED]
    best = best[ids[:SEED] != own]
    least = np.partition(best, len(best) - k)[len(best) - k] if len(best) >= k else -np.inf
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])  # bounds of the terms from each place on
    essential = max(1, int(np.searchsorted(-rest, -least, side="left"))) if len(order) and np.isfinite(least) else len(order)
    essential = min(essential, len(order))
    first = order[:essential]
    score = q[first] @ columns[first]
    found = np.flatnonzero((score + rest[essential] >= least) & (ids != own))
    score = score[found]
    for i in range(essential, len(order), PROBE):
        terms = order[i : i + PROBE]
        score = score + q[terms] @ columns[np.ix_(terms, found)]
        alive = score + rest[min(i + PROBE, len(order))] >= least
        if len(found) > k and i + PROBE < len(order):
            sure = score - _negative(q, top, low, order[i + PROBE :])
            least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
        found, score = found[alive], score[alive]
    return (found, score) if n else (np.zeros(0, dtype=np.int64), np.zeros(0))


def _negative(q: np.ndarray, top: np.ndarray, low: np.ndarray, terms: np.ndarray) -> float:
    """The most that the terms can take away."""
    return float(-np.minimum(np.minimum(q[terms] * top[terms], q[terms] * low[terms]), 0).sum())


def _search(queries: pa.Table, vectors: pa.Table, d: int, k: int) -> list[tuple]:
    ids, v = vectors.column("vec_id").to_numpy(), unpacked(vectors.column("v"), d)
    columns = np.ascontiguousarray(v.T)
    out: list[tuple] = []
    if not len(ids):
        return out
    top, low = (v.max(0), v.min(0)) if d else (np.zeros(0), np.zeros(0))
    for own, q in zip(queries.column("query_id").to_pylist(), unpacked(queries.column("q"), d), strict=True):
        found, score = maxscore(q, own, columns, ids, top, low, k)
        best = np.lexsort((ids[found], -score))[:k]
        out += [(own, q.tobytes(), int(ids[found[i]]), int(score[i])) for i in best]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each of queries (both vec_id, embedding).

    Components count as floor(256 * x); the score is their integer inner product, and ties go to the smaller id.
    Rows with a vector that is null or holds null or non-finite components, or without an id, take no part; shorter
    vectors count as padded with zeros; rows with the query's own id are no candidates; a query that repeats in full
    is answered once. Scores are exact where products stay below 2^53.
    """
    spark = vectors.sparkSession
    known = [x.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable("embedding")) for x in (vectors, queries)]
    d, n, m = max(dimension(x, "embedding") for x in known), known[0].count(), known[1].count()
    cores = spark.sparkContext.defaultParallelism
    shards = max(math.ceil(n / shard), min(math.ceil(n / 2048), 2 * cores), 1)
    blocks = max(math.ceil(m / shard), 1)

    def scaled(name: str, as_id: str):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed(np.floor(256 * matrix(batch.column("embedding"), d)))], names=[as_id, name])

        return run

    v = known[0].mapInArrow(scaled("v", "vec_id"), "vec_id long, v binary")
    q = known[1].mapInArrow(scaled("q", "query_id"), "query_id long, q binary").distinct()
    # Every block of queries meets every shard once; neither side's rows gather under one key.
    v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _search(left, right, d, k)
        return pa.table([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)

    best = q.groupBy("block", "shard").cogroup(v.groupBy("block", "shard")).applyInArrow(searched, "query_id long, q binary, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
