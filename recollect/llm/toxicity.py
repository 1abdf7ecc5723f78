"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Training reads the whole texts of a bounded sample of labelled rows (see SAMPLE): word beginnings that are far more
frequent among toxic than among ordinary documents make the content of the toxic dictionary, the most frequent
ordinary ones that of the ordinary dictionary; the toxic one holds the ordinary content too, so that the two differ on
toxic wording alone. Near copies in the sample count once: a document whose rarer words were mostly seen before is
left out. zstandard's own trainer, on the same documents' windows, tells the two less well (a test compares them).

Scoring covers whole texts: every window of about 128 bytes is compressed with either dictionary, and the bytes
that the toxic one saves are summed up in three figures whose weights (a logistic fit on sampled documents that the
dictionaries haven't seen, whole as well) calibrate the score. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import cut, private, release, values

WINDOW = 128  #: bytes of a window; it ends at the next space, or after twice as many
LEVEL = 12  #: compression level
SAMPLE = (2500, 5000)  #: toxic and ordinary documents that training reads at most
FREQUENT, ORDINARY = 80, 300  #: beginnings of frequent ordinary words, and characters of them that count
PART = 5  #: characters of an inner part of a fragment
TOXIC = 8_000  #: bytes of toxic content at most


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    #: What every text scores where no label tells toxic from ordinary.
    constant: float | None = None


def windows(text: str) -> list[bytes]:
    data, out, i = text.lower().encode("utf-8", "replace"), [], 0
    while i < len(data):
        j = data.find(b" ", i + WINDOW, i + 2 * WINDOW)
        j = min(len(data), i + 2 * WINDOW) if j < 0 else j
        out.append(data[i:j])
        i = j
    return out


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW + 16, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p).compress


def saved(text: str, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window."""
    a, b = _compressor(ordinary), _compressor(toxic)
    return np.array([len(a(w)) - len(b(w)) for w in windows(text)], dtype=np.float64)


def figures(text: str, ordinary: bytes, toxic: bytes) -> tuple[float, float, float]:
    d = np.maximum(saved(text, ordinary, toxic), 0)
    if not len(d):
        return 0.0, 0.0, 0.0
    return min(float(d.max()), 16.0), float(np.log1p(8 * d.mean())), float((d >= 2).mean() ** 0.5)


def words_of(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def _beginnings(docs: list[set[str]], among: Counter | None = None) -> Counter:
    """Documents of each word beginning of 4 to 11 characters, its space included."""
    n: Counter = Counter()
    for found in docs:
        parts = {(" " + w)[:k] for w in found for k in range(4, min(len(w) + 1, 11) + 1)}
        n.update(parts if among is None else (x for x in parts if x in among))
    return n


def _summed(known: DataFrame, counted: Callable[[list[set[str]]], Counter]) -> DataFrame:
    """g, n: what counted gives for the words of documents, a batch at a time, added up."""

    def run(batches):
        for batch in batches:
            n = counted([set(w) for w in values(batch.column("words"))])
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["g", "n"])

    return known.select("words").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def _words(docs: list[set[str]]) -> Counter:
    return Counter(" " + w for found in docs for w in found)


def _alike(fragments: list[str], ordinary: DataFrame) -> list[str]:
    """Of the ordinary words that hold an inner part of toxic fragments, the most frequent for each part: in both dictionaries, they
    make those parts tell nothing. Words of a single document don't count."""
    parts = {g[i : i + PART] for g in fragments for i in range(1, len(g) - PART + 1)}
    frequent = _summed(ordinary, _words).where("n > 1")

    def held(batches):
        for batch in batches:
            rows = [(part, -n, w) for w, n in zip(values(batch.column("g")), values(batch.column("n")), strict=True) for part in {w[i : i + PART] for i in range(len(w) - PART + 1)} & parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["part", "less", "word"])

    best = frequent.mapInArrow(held, "part string, less long, word string").groupBy("part").agg(F.min(F.struct("less", "word")).alias("b"))
    return sorted({r.word for r in best.select("b.word").collect()})  # one for each part of a fragment at most


def dictionaries(toxic: DataFrame, ordinary: DataFrame) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary content from documents with the words of each (words). Words are counted in tasks; the driver
    gets the beginnings that pass the bounds."""
    size1, size0 = toxic.count(), ordinary.count()
    least = max(4, 0.006 * size1)
    n1 = Counter({r.g: r.n for r in _summed(toxic, _beginnings).where(F.col("n") >= least).collect()})
    n0 = Counter({r.g: r.n for r in _summed(ordinary, lambda docs: _beginnings(docs, n1)).collect()})
    chosen: dict[str, float] = {}
    for g, n in n1.items():
        usual = (n0[g] + 1) / size0 * size1
        if n > 6 * usual and n - usual > 6 * usual**0.5:
            chosen[g] = (n - usual) / usual**0.5
    kept: list[str] = []
    for g in sorted(chosen, key=lambda g: (-len(g), g)):  # a beginning of one that is as frequent says nothing new
        if not any(k.startswith(g) and n1[k] >= 0.8 * n1[g] for k in kept):
            kept.append(g)
    kept.sort(key=lambda g: (chosen[g], g))
    common = _summed(ordinary, _beginnings).orderBy(F.desc(F.col("n") * F.length("g")), "g").limit(FREQUENT).orderBy("n", "g").collect()
    base = ("".join(_alike(kept, ordinary)) + "".join(r.g for r in common)[-ORDINARY:]).encode()
    return base, "".join(kept).encode()[-TOXIC:] + base


def novel(known: DataFrame) -> DataFrame:
    """doc_id, toxic of the documents that aren't near copies of earlier ones: at most half of whose long words, if they have any, occur in a
    document of a smaller id with the same label."""
    rare = known.select("doc_id", "toxic", F.explode(F.filter("words", lambda w: F.length(w) >= 8)).alias("word"))
    first = rare.groupBy("toxic", "word").agg(F.min("doc_id").alias("first"))
    seen = rare.join(first, ["toxic", "word"]).groupBy("doc_id", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("first") < F.col("doc_id")).alias("old"))
    return known.select("doc_id", "toxic").join(seen, ["doc_id", "toxic"], "left").where("n is null or 2 * old <= n").select("doc_id", "toxic")


def calibrated(contents: tuple[bytes, bytes], x: np.ndarray, y: np.ndarray) -> Model:
    """The model whose weights tell toxic (y 1) from ordinary documents (y 0) by their figures x."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.diag([0.1] * (len(w) - 1) + [1e-6])
        w += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    return Model(*contents, tuple(w), tuple(mean), tuple(scale))


def sampled(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """doc_id, toxic, text: a bounded sample of labelled rows outside the held-out fold, by a hash of their id.

    Rows with a null id, text or label teach nothing; an id labelled both ways counts as toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out("doc_id"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, sample[0]), (0, sample[1]))]
    # At most sum(sample) rows of two numbers: bounded whatever the table.
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Train on a bounded sample of labelled rows. Whole texts are read and words counted in tasks; the driver gets ids of sampled
    documents, beginnings that pass the bounds, and three figures of the documents that calibrate."""
    rows = cut(sampled(docs, labels, sample).repartition(16))

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic"), pa.array([sorted(words_of(t)) for t in values(batch.column("text"))], pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    known = cut(rows.mapInArrow(told, "doc_id long, toxic int, words array<string>"))
    kept = sorted((r.toxic, r.doc_id) for r in novel(known).collect())  # two numbers a row of the bounded sample
    by = {y: [i for t, i in kept if t == y] for y in (0, 1)}
    held = {y: ids[2::3] for y, ids in by.items()}
    if not held[0] or not held[1]:
        release(rows, known)
        return Model(b"", b"", (), (), (), constant=0.0)
    learn = [(i, y) for y, ids in by.items() for k, i in enumerate(ids) if k % 3 != 2]
    own = known.join(F.broadcast(rows.sparkSession.createDataFrame(learn, "doc_id long, toxic int")), ["doc_id", "toxic"])
    contents = dictionaries(own.where("toxic = 1"), own.where("toxic = 0"))

    def measured(batches):
        for batch in batches:
            x = np.array([figures(t, *contents) for t in values(batch.column("text"))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(3))], names=["doc_id", "a", "b", "c"])

    told_by = rows.sparkSession.createDataFrame([(i,) for y in held for i in held[y]], "doc_id long")
    by_id = {r[0]: r[1:] for r in rows.join(F.broadcast(told_by), "doc_id").select("doc_id", "text").mapInArrow(measured, "doc_id long, a double, b double, c double").collect()}
    release(rows, known)
    every = [*held[1], *held[0]]
    return calibrated(contents, np.array([by_id[i] for i in every]), np.array([1.0] * len(held[1]) + [0.0] * len(held[0])))


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column, called name, of scores (0 to 1, higher: likelier toxic).

    Null and empty texts get the score of no evidence; rows that repeat a text get the same score, whatever their id
    (null too). docs must not have a column of that name.
    """

    def scored(batches):
        for batch in batches:
            if model.constant is not None:
                p = np.full(len(batch), model.constant)
            else:
                x = np.array([figures(t or "", model.ordinary, model.toxic) for t in values(batch.column("text"))]).reshape(-1, 3)
                z = np.c_[(x - np.array(model.mean)) / np.array(model.scale), np.ones(len(x))] @ np.array(model.weights)
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, docs.select("*").schema.add(name, "double"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; see the module for the method. A null id is in no fold."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns as they were."""
    name = private(docs, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) < 0.5).select(*docs.columns)
