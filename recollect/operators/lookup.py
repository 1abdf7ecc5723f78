"""Lookup: five backends fused by weights that the question's intent sets, with boosts and a sign that more is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.fusion import RRF_K

# Weights of the backends (semantic, keyword, triplet, temporal, code) for each intent; other intents have those of any.
BACKENDS = ("semantic", "keyword", "triplet", "temporal", "code")
WEIGHTS = {"entity": (0.6, 0.3, 0.1, 0.0, 0.0), "relationship": (0.2, 0.1, 0.6, 0.0, 0.1), "code": (0.1, 0.4, 0.1, 0.0, 0.4), "temporal": (0.2, 0.1, 0.0, 0.7, 0.0), "any": (0.5, 0.3, 0.1, 0.1, 0.0)}
SURE, SEVERAL, WHOLE, DEEPER = 0.90, 0.10, 0.15, 0.55  #: keyword match that is enough, boosts, score below which one has to look deeper


def lookup(lanes: dict[str, DataFrame], question: str, limit: int = 20, intents: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """intent, id, score, rank, backends, escalate of the best hits for each intent.

    Lanes are (id, rank, text), of limit rows at most each; keyword has a column sure (0 to 1) too: where its first hit is sure
    enough, the other backends don't count. The temporal lane counts for temporal questions alone. A hit of several
    backends, or one that holds the whole question, is lifted. escalate says that even the best hit of the intent is weak.
    """
    spark = next(iter(lanes.values())).sparkSession
    weights = spark.createDataFrame([(i, b, w) for i in intents for b, w in zip(BACKENDS, WEIGHTS[i], strict=True) if w > 0 and (b != "temporal" or i == "temporal")], "intent string, backend string, weight double")
    rows = None
    for name, lane in lanes.items():
        part = lane.select(F.lit(name).alias("backend"), "id", "rank", "text")
        rows = part if rows is None else rows.unionByName(part)
    enough = lanes["keyword"].where("rank = 1").agg(F.coalesce(F.max("sure"), F.lit(0.0)).alias("enough"))
    rows = rows.join(F.broadcast(enough)).where((F.col("backend") == "keyword") | (F.col("enough") < SURE)).join(F.broadcast(weights), "backend")
    by = rows.groupBy("intent", "id").agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("s"), F.countDistinct("backend").alias("backends"), F.max(F.lower("text").contains(question.lower())).alias("whole"))
    lifted = F.col("s") + F.when(F.col("backends") >= 2, SEVERAL).otherwise(0.0) + F.when(F.col("whole"), WHOLE).otherwise(0.0)
    own = Window.partitionBy("intent")
    # A window over one question's hits.
    ranked = by.withColumn("score", F.round(lifted, 9)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "id")).cast("long"))
    ranked = ranked.withColumn("escalate", F.max("score").over(own) < DEEPER)
    return ranked.where(F.col("rank") <= limit).select("intent", "id", "score", "rank", "backends", "escalate")
