"""Near-duplicate documents by MinHash with odd sketches.

Texts with the same shingle set form a class. Class representatives meet in bands of MinHash values and are compared
as linking.py has it. A candidate must pass its odd sketches first: the set's smallest fingerprint in each of 1024
bins (a one-permutation MinHash sample; of small sets nearly all elements) toggles a bit of a parity bitmap, and the
population count of two bitmaps' XOR tells in how many samples the sets differ. Every link is confirmed on the
full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import cut, private, release, sieved
from recollect.llm.linking import in_buckets, labelled, link
from recollect.llm.words import mix, odd_multipliers, shingle_sets

BANDS, ROWS = 20, 4  #: a pair at 0.8 shares a band with a probability of 0.99997
BINS, SKETCH = 1024, 2048  #: samples and bits of an odd sketch
_LONGS = SKETCH // 64
_S = [f"s{i}" for i in range(_LONGS)]


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x BANDS) and odd sketches (n x longs) of non-empty sets of sorted fingerprints."""
    k, n = BANDS * ROWS, len(sets)
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    least = np.empty((n, k), dtype=np.uint64)
    for i, m in enumerate(odd_multipliers(k, 1234)):
        least[:, i] = np.minimum.reduceat((flat ^ m) * m, starts)
    column = np.arange(k, dtype=np.uint64)
    mixed = mix(least + column * np.uint64(0xD6E8FEB86659FD93))
    keys = mix((mixed.reshape(n, BANDS, ROWS) * odd_multipliers(ROWS, 5)).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    # Sets are sorted, so the first fingerprint of a bin is its smallest.
    bins = (flat // np.uint64((1 << 64) // BINS)).astype(np.int64) + np.repeat(np.arange(n), sizes) * BINS
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    bits = (mix(flat[first]) % np.uint64(SKETCH)).astype(np.int64) + bins[first] // BINS * SKETCH
    parity = (np.bincount(bits, minlength=n * SKETCH) & 1).astype(np.uint8)
    return keys.view(np.int64), np.packbits(parity).view(np.int64).reshape(n, _LONGS)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, fp (fingerprint of the set), bands, s0 ... of every row."""

    def signed(batches):
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            for i in range(0, len(column), 512):
                sets = list(shingle_sets(column.slice(i, 512), shingle))
                keys = np.zeros((len(sets), BANDS), dtype=np.int64)
                sketches = np.zeros((len(sets), _LONGS), dtype=np.int64)
                if full := [j for j, s in enumerate(sets) if len(s)]:
                    keys[full], sketches[full] = _signatures([sets[j] for j in full])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, 512),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
                        *(pa.array(np.ascontiguousarray(sketches[:, j])) for j in range(_LONGS)),
                    ],
                    names=["doc_id", "n_shingles", "fp", "bands", *_S],
                )

    schema = "doc_id long, n_shingles long, fp binary, bands array<long>, " + ", ".join(f"{s} long" for s in _S)
    return docs.select("doc_id", "text").mapInArrow(signed, schema)


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, shingles of the documents in ids."""

    def made(batches):
        for batch in batches:
            column, found = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            for i in range(0, len(column), 512):
                sets = list(shingle_sets(column.slice(i, 512), shingle))
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([found.slice(i, 512), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"])

    rows = sieved(docs.select("doc_id", "text"), F.col("doc_id").cast("long"), ids, "id", "wanted").where("wanted")
    return rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text").mapInArrow(made, "id long, shingles array<long>")


def _near(percent: int):
    """The condition on two sketches, met by pairs at the threshold but for about one in a million.

    With sizes m and n and similarity s, the sets differ in d = (m + n) (1 - s) / (1 + s) elements at most, and each
    toggles one bit on average: its own, no bit if an element of its set hides it in its bin, two if it hides one of the
    other set. How far the count strays from d grows with how full the bins are. However large the sets, at most
    about (1 - s) BINS samples differ, each with two bits; bits toggled twice vanish, which only lowers the count.
    """
    s = percent / 100
    samples = (1 - s) * BINS + 5 * (s * (1 - s) * BINS) ** 0.5
    most = SKETCH / 2 * (1 - np.exp(-2 * 2 * samples / SKETCH)) + 20

    def near(l: str, r: str) -> F.Column:
        toggled = sum((F.bit_count(F.col(f"{l}.{x}").bitwiseXOR(F.col(f"{r}.{x}"))) for x in _S), F.lit(0))
        both = (F.col(f"{l}.n") + F.col(f"{r}.n")).cast("double")
        differ, hidden = both * (1 - s) / (1 + s), F.least(both / (2 * BINS), F.lit(1.0))
        close = F.least(F.col(f"{l}.n"), F.col(f"{r}.n")) * 100 >= F.greatest(F.col(f"{l}.n"), F.col(f"{r}.n")) * percent
        return close & (toggled <= F.least(differ + 3.5 * F.sqrt(differ * hidden) + 1, F.lit(float(most))))

    return near


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    sets = cut(_sets(docs, ids, shingle))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n"), (F.size("x") + F.size("y")).cast("long").alias("m"))
    links = cut(both.where(F.col("n") * 100 >= (F.col("m") - F.col("n")) * percent).select("a", "b"))
    release(ids, sets)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked if their shingle sets' Jaccard similarity is percent / 100 or more. Documents without
    words (null and empty texts) are linked with nothing; so are rows without an id, whose component is null and
    which are kept. Rows that repeat an id are one document.
    """
    signed = cut(signatures(docs, shingle))
    known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in _S)))
    shared = in_buckets(classes.select("rep", "bands"))
    found = link(shared, classes.select("rep", "n", "bands", *_S), _near(percent), lambda pairs: _confirmed(docs, pairs, shingle, percent))
    release(shared)

    # Classes and rows without their sketches: little is left when the result is read.
    placed = cut(labelled(classes.select("fp", "rep"), found).select("fp", "component"))
    kept = cut(signed.select("doc_id", "n_shingles", "fp"))
    release(signed, classes, found)
    rows = kept.join(placed, "fp", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).cast("long")
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document (the smallest id) of each group of near duplicates."""
    gone = cut(near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct())
    mark = private(docs, "gone")
    rows = sieved(docs, F.col("doc_id").cast("long"), gone, "id", mark)
    hit = rows.where(F.col(mark)).join(gone.withColumnRenamed("id", mark + "_id"), F.col("doc_id") == F.col(mark + "_id"), "left_anti")
    return rows.where(~F.col(mark)).unionByName(hit).select(*docs.columns)
