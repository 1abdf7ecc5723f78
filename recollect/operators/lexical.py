"""Keyword retrieval: an index of postings written once, BM25 from the postings of a query's terms, term overlap.

The index lies in the shared folder: postings (term, memory_id, tf, len), partitioned by a hash of the term, the
fingerprint of every text, and one row of statistics. A query reads the partitions of its terms only; texts are tokenised when the index is written, not when
it is asked. The index of a table is written again when the table's files change.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import lex_tokens, python_lex_tokens, python_words, words
from recollect.operators.graph import shared_folder
from recollect.sources.files import listing

K1, B = 1.2, 0.75
LEAST_BUCKETS, BUCKET_BYTES = 64, 32 << 20  #: partitions of the postings: a bucket for so many bytes of the table
AT_ONCE = 64  #: texts whose words are counted at once
WORD = re.compile("[a-z0-9]+")  #: of a lower-case text, as words() has them


@dataclass(frozen=True)
class Index:
    postings: DataFrame  #: bucket, term, memory_id, tf, len
    stats: DataFrame  #: one row: n, avg_len
    prints: DataFrame  #: memory_id, print: the MD5 of every text
    id_: str
    buckets: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def counted(batches: Iterator[pa.RecordBatch], id_: str) -> Iterator[pa.RecordBatch]:
    """Terms of batches (id, lower-case text or its words) with their counts, AT_ONCE texts at a time: words take some fifty bytes each as Python's strings."""
    for whole in batches:
        for first in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(first, AT_ONCE)
            ids, terms, tfs, lens = [], [], [], []
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = w.as_py() or ()
                found = Counter(WORD.findall(said) if isinstance(said, str) else said)
                n = found.total()
                ids += [i] * len(found)
                terms += found.keys()
                tfs += found.values()
                lens += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lens, pa.int64())], names=[id_, "term", "tf", "len"])


def index(docs: DataFrame, id_: str = "memory_id", text: str = "content", table: DataFrame | None = None) -> Index:
    """The index of docs; table, whose files docs come from, tells by their listing whether one that was written before still holds."""
    spark = docs.sparkSession
    known = spark.__dict__.setdefault("_recollect_indexes", {})
    files = listing(table if table is not None else docs)
    key = None if table is None else (id_, text, tuple(sorted((path, state) for path, (state, _) in files.items())))
    if key is not None and key in known:
        return known[key]
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_BYTES < sum(size for _, size in files.values()):
        buckets *= 2

    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    # Texts are handed over as they are, which takes less than lists of their words; they are counted where they are, and only the counts are dealt out by term.
    rows = docs.select(F.col(id_).cast("long").alias(id_), F.lower(text).alias("w")).mapInArrow(lambda batches: counted(batches, id_), f"{id_} long, term string, tf long, len long")
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets))
    # A frequent term's postings are dealt over several tasks.
    dealt = ("bucket", F.pmod(F.col(id_), F.lit(4)))
    (rows.repartition(*dealt) if buckets == LEAST_BUCKETS else rows.repartition(4 * buckets, *dealt)).sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(f"{id_} long, term string, tf long, len long, bucket int").parquet(f"{path}/postings")
    lengths = postings.groupBy(id_).agg(F.max("len").alias("len"))
    docs.select(F.col(id_).cast("long").alias(id_), F.unhex(F.md5(text)).alias("print")).write.parquet(f"{path}/prints")
    prints = spark.read.schema(f"{id_} long, print binary").parquet(f"{path}/prints")
    # Texts without a word have no postings, but count.
    total = prints.agg(F.count("*").alias("n"))
    stats = total.crossJoin(lengths.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("words"))).select("n", (F.col("words") / F.greatest(F.col("n"), F.lit(1))).alias("avg_len"))
    stats.write.parquet(f"{path}/stats")
    made = Index(postings, spark.read.schema("n long, avg_len double").parquet(f"{path}/stats"), prints, id_, buckets)
    if key is not None:
        known[key] = made
    return made


def bm25_all(found: Index, queries: dict[str, str]) -> DataFrame:
    """query, id, score of every document that holds a term of a query, for all queries in one pass over their terms' postings."""
    wanted = [(q, t) for q, text in queries.items() for t in sorted(set(python_words(text)))]
    spark = found.postings.sparkSession
    asked = spark.createDataFrame(wanted or [("", "")], "query string, term string")
    terms = sorted({t for _, t in wanted})
    if not terms:
        return found.postings.select(F.lit("").alias("query"), found.id_, F.lit(0.0).alias("score")).where(F.lit(False))
    buckets = sorted({zlib.crc32(t.encode()) % found.buckets for t in terms})
    hits = found.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    # As many rows as the queries have terms.
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(found.stats)).join(F.broadcast(asked), "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.groupBy("query", found.id_).agg(F.round(F.sum(part), 6).alias("score"))


def bm25(found: Index, query: str) -> DataFrame:
    """id, score of every document that holds a query term."""
    return bm25_all(found, {"": query}).select(found.id_, "score")


def top(scored: DataFrame, n: int, id_: str = "memory_id") -> DataFrame:
    """The n best, ties by id, with their rank; only these n rows meet in one place."""
    best = scored.orderBy(F.desc("score"), id_).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)).cast("long"))


def term_overlap(text: Column, query: str) -> Column:
    """Share of the query's tokens that the text has."""
    tokens = python_lex_tokens(query)
    if not tokens:
        return F.lit(0.0)
    return F.size(F.array_intersect(lex_tokens(text), F.array(*map(F.lit, tokens)))) / F.lit(float(len(tokens)))


def terms(text: Column) -> Column:
    """Distinct lower-case words of three letters or digits at least."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= 3))


def frequencies(found: Index) -> DataFrame:
    """term, df, cf: document and collection frequency of every word."""
    return found.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
