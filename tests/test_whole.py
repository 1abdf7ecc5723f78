"""Queries do the whole job: every row counts, whatever the size of the table."""

import numpy as np
import pyarrow as pa

from recollect import queries
from recollect.operators import lexical, similar

SF = "/root/testdata/sf0.001"


def test_surprises_are_those_of_all_events(spark):
    tape = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    off = (tape["value"] - tape.groupby("event_type")["value"].transform("mean")).abs() >= 20
    row = queries.QUERIES["surprise_learning_stats"](spark, SF).first()
    assert row.passed == off.sum() and row.tracked == tape["props"].nunique()
    assert row.adjustment == round(0.05 * off.sum(), 4)


def test_only_pairs_near_the_threshold_are_dealt_out(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    y = x[:100] + 0.3 * rng.standard_normal((100, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate([x, y]).tolist())], "vec_id long, embedding array<double>")
    met = {(r.a, r.b) for r in similar.candidates(df, 0.9).collect()}
    u = np.concatenate([x, y])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = {(a, b) for a, b in np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist()}
    assert len(near) >= 90 and len(near & met) >= 0.95 * len(near)
    assert len(met) < 5000  # hundreds of thousands share a key


def test_words_are_counted_few_texts_at_a_time():
    words = [["a", "b", "a"], None, []] + [[f"w{i}", "a"] for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(303), pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["memory_id", "w"])
    out = list(lexical.counted(iter([batch]), "memory_id"))
    assert max(len(set(b.column("memory_id").to_pylist())) for b in out) <= lexical.AT_ONCE
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert len(rows) == 602 and rows[:3] == [(0, "a", 2, 3), (0, "b", 1, 3), (3, "w0", 1, 2)]


def test_texts_are_counted_as_their_words_are():
    texts = ["a b-a É2x", None, "", "k_k 7"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts, pa.string())], names=["memory_id", "w"])
    rows = [tuple(r.values()) for b in lexical.counted(iter([batch]), "memory_id") for r in b.to_pylist()]
    assert rows == [(0, "a", 2, 4), (0, "b", 1, 4), (0, "2x", 1, 4), (3, "k", 2, 3), (3, "7", 1, 3)]
