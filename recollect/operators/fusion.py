"""Fusion of ranked lanes and rescoring of the few rows they return."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lanes: dict[str, DataFrame], weights: dict[str, float] | None = None, id_: str = "memory_id") -> DataFrame:
    """id, score, lanes: sum of weight / (60 + rank) over lanes (id, rank); each lane holds a bounded number of rows."""
    weights = weights or {}
    rows = None
    for name, lane in lanes.items():
        part = lane.select(id_, (F.lit(float(weights.get(name, 1.0))) / (RRF_K + F.col("rank"))).alias("part"), F.lit(name).alias("lane"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(id_).agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("lanes"))


def normalised(fused: DataFrame) -> DataFrame:
    """score divided by the largest: a window over the lanes' rows, of which there are few."""
    most = F.max("score").over(Window.partitionBy(F.lit(0)))
    return fused.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score")))


def drifted(score: F.Column, access: F.Column, n: F.Column) -> F.Column:
    """Less for what is recalled often, more for what isn't."""
    return score * (1 - 0.25 * F.least(F.lit(1.0), access / 10)) * (1 + F.least(F.lit(0.3), F.sqrt(F.log(n + 1) / (access + 1))))


def ucb1(score: F.Column, access: F.Column, n: F.Column) -> F.Column:
    return score + 1.414 * F.sqrt(F.log(n + 1) / (access + 1))


def calibrated(cosine: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-(3.27 * cosine - 0.85)))


def prefilter(ranked: DataFrame, limit: int, budget: int, on: F.Column | None = None) -> DataFrame:
    """Of ranked rows (rank, score, lexical, near, realm, kind) those worth rescoring, at most budget; all of them where on is false.

    near says that a row is a neighbour of one of the first three. Windows are over one query's rows.
    """
    every = Window.partitionBy(F.lit(0))
    head = F.collect_set(F.when(F.col("rank") <= 5, F.struct("realm", "kind"))).over(every)
    like = F.array_contains(head, F.struct("realm", "kind"))
    keep = (F.col("rank") <= limit) | F.col("lexical") | F.col("near") | ((F.col("score") >= F.max("score").over(every) / 2) & like)
    off = F.lit(False) if on is None else ~on
    rows = ranked.withColumn("_off", off).withColumn("_keep", keep | off).where("_keep").drop("_keep")
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("rank")).cast("long"))
    return rows.where((F.col("place") <= budget) | F.col("_off")).drop("_off")


def diversify(ranked: DataFrame, n: int, balance: float = 0.7, key: str = "string") -> DataFrame:
    """memory_id, place: greedy selection by balance * score - (1 - balance) * largest token Jaccard with those taken.

    Greedy over one query's candidates, of which lanes leave at most 160.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        most = max(rows["score"].max(), 1e-12)
        left = [(float(r.score) / most, int(r.memory_id), set(r.tokens)) for r in rows.itertuples()]
        taken: list[tuple[float, int, set]] = []
        while left and len(taken) < n:
            def gain(x):
                like = max((len(x[2] & t[2]) / max(1, len(x[2] | t[2])) for t in taken), default=0.0)
                return (balance * x[0] - (1 - balance) * like, -x[1])

            best = max(left, key=gain)
            left.remove(best)
            taken.append(best)
        return pd.DataFrame({"query": rows["query"].iloc[0], "memory_id": [t[1] for t in taken], "place": range(1, len(taken) + 1)})

    return ranked.groupBy("query").applyInPandas(pick, f"query {key}, memory_id long, place int")
