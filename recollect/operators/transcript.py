"""Compaction of transcripts under a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import lex_tokens, token_estimate


def _selected(rows: pd.DataFrame, budget: int, slack: float = 1.2, tail: int = 2) -> list[bool]:
    """Which turns of a session (i, cost, score, good) stay: the best of the good ones while they fit, then others that still fit, best
    first, then the last ones unless that goes too far beyond the budget."""
    best = rows.sort_values(["score", "i"], ascending=[False, True])
    cost, stays, spent = rows.set_index("i")["cost"], set(), 0
    for i in best.loc[best["good"], "i"]:
        if spent + cost[i] > budget:  # the good ones that are worse than this go as well
            break
        stays.add(i)
        spent += cost[i]
    last = range(max(0, len(rows) - tail), len(rows))
    for i, most in [*((i, budget) for i in best.loc[~best["good"], "i"]), *((i, slack * budget) for i in last)]:
        if i not in stays and spent + cost[i] <= most:
            stays.add(i)
            spent += cost[i]
    return [i in stays for i in rows["i"]]


def compact(turns: DataFrame, budget: int, k: float = 0.5) -> DataFrame:
    """session, turn, score, cost, good of the turns (session, turn, role, text) that stay.

    A turn scores by its role, by the share of the session's last question that its words hold, and by its place; it is good at the
    median and k times the median deviation, or above. Which ones stay is worked out on these numbers, a session at a time.
    """
    session = Window.partitionBy("session")
    t = turns.select("session", "turn", "role", lex_tokens("text").alias("tokens"), token_estimate(F.col("text")).alias("cost"))
    t = t.withColumn("n", F.count("*").over(session)).withColumn("i", F.row_number().over(session.orderBy("turn")).cast("long") - 1)
    asked = t.where("role = 'user'").groupBy("session").agg(F.max_by("tokens", "turn").alias("asked"))
    t = t.join(asked, "session")
    like = F.when(F.size("asked") > 0, F.size(F.array_intersect("tokens", "asked")) / F.size("asked")).otherwise(0.0)
    place = F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(1.0)
    score = F.when(F.col("role") == "user", 1.1).otherwise(1.0) * (0.65 * like + 0.25 * (0.2 + 0.8 * place) + 0.10)
    t = t.select("session", "turn", "i", "cost", score.alias("score"))
    middle = t.groupBy("session").agg(F.percentile("score", 0.5).alias("med"))
    t = t.join(middle, "session")
    spread = t.groupBy("session").agg(F.percentile(F.abs(F.col("score") - F.col("med")), 0.5).alias("mad"))
    t = t.join(spread, "session").select("session", "turn", "i", "cost", F.round("score", 9).alias("score"), (F.col("score") >= F.col("med") + k * F.col("mad")).alias("good"))

    def stay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return rows[_selected(rows, budget)].assign(score=lambda r: r["score"].round(6))[["session", "turn", "score", "cost", "good"]]

    return t.groupBy("session").applyInPandas(stay, f"session {dict(turns.dtypes)['session']}, turn {dict(turns.dtypes)['turn']}, score double, cost long, good boolean")
