"""Graph operators on edge lists: traversal, PageRank, labels, analogy, supersession. Iterations are joins cut at every round."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.sources.files import remove


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; one of our own only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_graph_folder", None) or "file://" + tempfile.mkdtemp(prefix="spark-recollect-")
        spark._graph_folder = folder
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so a round doesn't recompute those before it. It is removed by unsettle(), or when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    if not _WRITTEN:
        atexit.register(lambda: [unsettle(x) for x in list(_WRITTEN.values())])
    found.settled_at = path
    _WRITTEN[path] = found
    return found


_WRITTEN: dict[str, DataFrame] = {}


def unsettle(*frames: DataFrame) -> None:
    """Remove what settled() wrote for frames that nothing reads any more."""
    for df in frames:
        if _WRITTEN.pop(getattr(df, "settled_at", ""), None) is not None:
            with contextlib.suppress(OSError, Py4JError):  # at exit the session may have ended before
                remove(df, df.settled_at)


def bfs(edges: DataFrame, start: str, hops: int = 3, direction: str = "both", predicate: str | None = None) -> DataFrame:
    """node, hop: everything within so many hops of a node, at its smallest distance."""
    if predicate is not None:
        edges = edges.where(F.col("predicate") == predicate)
    out, back = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")), edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))
    steps = {"outgoing": out, "incoming": back}.get(direction)
    steps = (out.unionByName(back) if steps is None else steps).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, hop int")
    frontier = seen
    for hop in range(1, hops + 1):
        new = frontier.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = settled(new.select("node", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest(edges: DataFrame, start: str, end: str, hops: int = 4) -> DataFrame:
    """node, hop of all nodes on a shortest undirected connection, which has twice so many hops at most."""
    there, back = (settled(bfs(edges, node, hops)) for node in (start, end))
    both = there.join(back.withColumnRenamed("hop", "left"), "node").withColumn("all", F.col("hop") + F.col("left"))
    least = both.agg(F.min("all").alias("least"))
    return both.join(F.broadcast(least)).where(F.col("all") == F.col("least")).select("node", "hop")


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, seed: str | None = None) -> DataFrame:
    """node, score: PageRank of undirected edges, restarting anywhere or at a seed.

    The mass of nodes without edges does not arise, as each edge goes both ways."""
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct()
    out = both.groupBy("a").agg(F.count("*").alias("degree"))
    links = settled(both.join(out, "a"))
    nodes = settled(out.select(F.col("a").alias("node")))
    n = nodes.count()
    own = (lambda all_, one: F.lit(all_)) if seed is None else (lambda all_, one: F.when(F.col("node") == seed, one).otherwise(0.0))
    ranks = nodes.withColumn("score", own(1.0 / n if n else 0.0, 1.0))
    for _ in range(iterations):
        got = links.join(ranks, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("score") / F.col("degree")).alias("s"))
        former, ranks = ranks, settled(got.select("node", (own((1 - damping) / max(1, n), 1 - damping) + damping * F.col("s")).alias("score")))
        unsettle(former)
    unsettle(links)
    return ranks


def label_propagation(edges: DataFrame, iterations: int = 6) -> DataFrame:
    """node, label: synchronous label propagation; ties go to the smallest label."""
    both = settled(edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    best = Window.partitionBy("node").orderBy(F.desc("n"), "label")
    for _ in range(iterations):
        votes = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node"), "label").agg(F.count("*").alias("n"))
        former, labels = labels, settled(votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("node", "label"))
        unsettle(former)
    unsettle(both)
    return labels


def analogy(edges: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """answer, predicate, weight: what c leads to by the predicates that lead from a to b, heaviest first."""
    shared = edges.where((F.col("subject") == a) & (F.col("object") == b)).select("predicate").distinct()
    return edges.where(F.col("subject") == c).join(F.broadcast(shared), "predicate", "left_semi").select(F.col("object").alias("answer"), "predicate", "weight")


def as_of(facts: DataFrame, day: str) -> DataFrame:
    """The facts valid at a time: from their start on and before their end."""
    t = F.lit(day).cast("timestamp")
    return facts.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
