"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

On a bounded sample rotations are learnt that make the signs of the rotated vectors balanced, tight binary codes of 64
bits. The parts of each code are keys of as many hash tables; a vector probes each table with its own key and those one
bit away, so pairs meet if any part differs in one bit at most. Keys grow with the number of vectors (16 bits up to a
quarter of a million, then 21, then 32), so that chance meetings stay few for each vector, and the number of tables
grows with them, so that pairs at the threshold are found as before. Pairs whose codes differ in few bits are then compared by
the cosine of the original vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import components, cut
from recollect.llm.vectors import dimension, matrix, packed, unpacked, usable

SAMPLE = 4096  #: vectors that the rotation is learnt from at most
BITS = 64  #: of a code
DIFFER = 22  #: bits of each 64 in which a candidate's codes may differ; a pair at 0.9 differs in about 9
MISSED = 0.06  #: share of the pairs at the threshold that may meet in no table


def learn(sample: np.ndarray, seed: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to BITS dimensions) by iterative quantisation of unit vectors."""
    mean = sample.mean(0)
    x = sample - mean
    d = x.shape[1]
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:BITS]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-BITS // max(1, min(d, len(axes))))):
        y = x @ axes.T
        r, _ = np.linalg.qr(rng.standard_normal((y.shape[1], y.shape[1])))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        out.append(axes.T @ r)
    return mean, np.concatenate(out, axis=1)[:, :BITS]


def tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, codes) for n vectors.

    A bit of two vectors at the threshold agrees with a probability of 1 - angle / pi at least, and a table brings
    them together if one bit of the key differs at most.
    """
    parts = 4 if n <= 1 << 18 else 3 if n <= 1 << 24 else 2
    part = BITS // parts
    same = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    met = same**part + part * same ** (part - 1) * (1 - same)
    return part, max(2, int(np.ceil(np.log(MISSED) / np.log(1 - min(met, 0.999)) / parts)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component where squares could leave the range of doubles."""
    most = np.abs(x).max(1, keepdims=True, initial=0)
    odd = (most > 1e140) | (most < 1e-140) & (most > 0)
    return np.where(odd, x / np.where(odd, most, 1), x)


def _codes(x: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    u = _unit(x)
    return [np.ascontiguousarray(np.packbits(((u - mean) @ p >= 0).astype(np.uint8), axis=1)).view(np.int64).ravel() for mean, p in models]


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows without an id
    (their component is null, and they are kept). Shorter vectors count as padded with zeros. Equal vectors are
    compared once for all their copies, whose links to each other are counted without being listed.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    filled = F.exists("embedding", lambda x: x != 0)
    usable_rows = rows.where(F.col("vec_id").isNotNull() & usable("embedding") & filled)
    d = dimension(usable_rows, "embedding")
    none = F.when(F.lit(True), F.lit(0)).cast("long")
    if not d:
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = usable_rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    sample = _unit(_scaled(matrix(sample.column("embedding").combine_chunks(), d)))
    part, codes = tables(usable_rows.count(), threshold)
    models = [learn(sample, seed) for seed in range(codes)]

    def coded(batches):
        for batch in batches:
            x = _scaled(matrix(batch.column("embedding"), d))
            coded_ = _codes(x, models) if len(x) else [np.zeros(0, dtype=np.int64)] * codes
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x + 0.0], pa.binary()), packed(x), *(pa.array(c) for c in coded_)], names=["vec_id", "fp", "v", *(f"c{i}" for i in range(codes))])

    signed = cut(usable_rows.mapInArrow(coded, "vec_id long, fp binary, v binary, " + ", ".join(f"c{i} long" for i in range(codes))))
    classes = cut(signed.groupBy("fp").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), *(F.first(f"c{i}").alias(f"c{i}") for i in range(codes))))

    cuts = [(i, s) for i in range(codes) for s in range(0, BITS - part + 1, part)]
    key = lambda i, s: F.shiftrightunsigned(f"c{i}", s).bitwiseAND(F.lit((1 << part) - 1).cast("long"))
    # What grows with the vectors is merged: by the size of their files, keys and classes of many vectors would pass for
    # small tables and be broadcast by the driver.
    keyed = classes.select("rep", *(f"c{i}" for i in range(codes)), F.posexplode(F.array(*(key(i, s) for i, s in cuts))).alias("t", "key"))
    probes = keyed.withColumn("key", F.explode(F.array(F.col("key"), *(F.col("key").bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(part)))))
    l, r = keyed.alias("l"), probes.alias("r")
    differ = sum((F.bit_count(F.col(f"l.c{i}").bitwiseXOR(F.col(f"r.c{i}"))) for i in range(codes)), F.lit(0))
    pairs = l.join(r.hint("merge"), (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") < F.col("r.rep")) & (differ <= DIFFER * codes))
    pairs = pairs.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()

    def compared(batches):
        for batch in batches:
            x, y = unpacked(batch.column("x"), d), unpacked(batch.column("y"), d)
            cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(cosine >= threshold))

    held = classes.select("rep", "v").hint("merge")
    both = pairs.join(held.select(F.col("rep").alias("a"), F.col("v").alias("x")), "a").join(held.select(F.col("rep").alias("b"), F.col("v").alias("y")), "b")
    links = cut(both.mapInArrow(compared, "a long, b long"))

    copies = classes.select("rep", "copies").hint("merge")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(copies.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("near")).hint("merge")
    found = components(links).withColumnRenamed("id", "rep").hint("merge")
    # A class's row is small from here on.
    placed = classes.select("fp", "rep", "copies").join(linked, "rep", "left").join(found, "rep", "left")
    placed = placed.select("fp", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = signed.select("vec_id", "fp").join(placed.hint("merge"), "fp").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & usable("embedding") & filled, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
