"""Shared helpers of the training-data operators: reading tables, durable cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; one of our own only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = getattr(spark, "_recollect_folder", None)
    if folder is None:
        folder = spark._recollect_folder = "file://" + tempfile.mkdtemp(prefix="spark-recollect-")
    return folder


#: Spark removes a query's shuffle files when the query ends, instead of when the driver's garbage collector gets to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, watched: Observation | None = None, *figures: Column) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: recovery never reaches beyond it.

    watched gets aggregates of the rows as they are written. What nothing reads any more is removed by release().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recollect-{uuid.uuid4().hex}"
    usual = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.observe(watched, *figures) if watched else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if usual is None else spark.conf.set(CLEANUP, usual)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def release(*frames: DataFrame | None) -> None:
    """Remove what cut() wrote for these frames, once all that was read from them is written itself."""
    for df in frames:
        if path := getattr(df, "written_to", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            del df.written_to


def private(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


SIEVE = 1 << 24  #: bits of a sieve: 262,144 rows of two numbers, whatever is in it


def sieved(df: DataFrame, key: Column, keys: DataFrame, column: str, name: str) -> DataFrame:
    """df with a boolean column that is true wherever key is among the keys, and rarely elsewhere.

    The keys are folded into a bitmap of a fixed size, which is broadcast; an exact join is left to the caller, who
    thus shuffles few of the rows that have no partner.
    """
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit(SIEVE - 1).cast("long"))
    word, bits = private(df, "sieve_word"), private(df, "sieve_bits")
    folded = keys.select(at(F.col(column)).alias("h")).groupBy(F.shiftright("h", 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias(bits))
    looked = df.withColumn(private(df, "sieve_at"), at(key))
    place = looked.columns[-1]
    looked = looked.join(F.broadcast(folded), F.shiftright(F.col(place), 6) == F.col(word), "left")
    bit = F.expr(f"shiftrightunsigned(coalesce(`{bits}`, 0L), cast(`{place}` & 63 as int)) & 1L") == 1
    return looked.withColumn(name, bit).drop(place, word, bits)


def values(column: Iterable) -> Iterator:
    """The values of an Arrow column one at a time, so that a batch's texts aren't all held twice."""
    return (x.as_py() for x in column)


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a row: its id and its text. Rows that repeat both count as one document."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


LINKS = 250_000  #: links of a partition, at least, in the search for components; as many at most may be joined by one task


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest reachable id (id, component) of every id in the links (u, v) of one task."""
    links = [np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")]) for b in batches]
    if not links:
        return
    ids, ends = np.unique(np.concatenate(links, axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    least, former = np.arange(len(ids)), None
    while former is None or (least != former).any():
        # Every root takes the smallest root among its neighbours, then all ids follow their roots.
        former, least = least, least.copy()
        low = np.minimum(former[u], former[v])
        np.minimum.at(least, former[u], low)
        np.minimum.at(least, former[v], low)
        while (least != least[least]).any():
            least = least[least]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[least])], names=["id", "component"])


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 100, at_once: int = 0) -> DataFrame:
    """Smallest reachable id of every id in the links: columns id, component.

    Alternates the large-star and small-star steps; each is one grouped minimum (combined before the shuffle,
    so a hub costs one row a task) and one join that adaptive execution can split. The driver sees two numbers
    a round, never ids: joins are merges, as links that make small files may be many. Every round is written to the
    shared folder. Where so many links at most (at_once) are left, one task joins them without further rounds.
    """
    watched = Observation()
    links = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), watched, F.count("*").alias("n"))
    written, seen, size = links, None, watched.get["n"]
    for _ in range(rounds):
        if size <= at_once:
            found = cut(links.coalesce(1).mapInArrow(_reached, "id long, component long"))
            release(written)
            return found
        # So many links fit a task well; Spark doesn't shuffle where one partition holds them all.
        links = links.coalesce(-(-size // LINKS) or 1)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        watched = Observation()
        former, links = written, cut(small.where("u <> v").distinct(), watched, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        release(former)
        written, now = links, watched.get
        if now == seen or not now["n"]:
            break
        seen, size = now, now["n"]
    else:
        raise RuntimeError("connected components did not settle")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = cut(links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
    release(written)
    return found
