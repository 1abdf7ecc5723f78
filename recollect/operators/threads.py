"""Threads of conversation by their weighted terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that tell no thread.
THREAD_STOP = (
    "the a an and or but in on at to for of with by from is are was were be been have has had do does did will "
    "would could should may might can this that these those it its we i you they he she what how when where which "
    "who not no yes if then so just use run add get set let put make also now need want like as up out into please "
    "thanks ok okay sure good great going here there them"
).split()


def fingerprints(turns: DataFrame) -> DataFrame:
    """session, term, weight: share of a term among the terms of a session's turns (each once a turn), less for terms of many turns."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0)))
    terms = turns.select("session", F.explode(F.array_except(words, F.array(*map(F.lit, THREAD_STOP)))).alias("term"))
    counts = terms.groupBy("session", "term").agg(F.count("*").alias("df"))
    n = turns.groupBy("session").agg(F.count("*").alias("n"))
    total = F.sum("df").over(Window.partitionBy("session"))
    weight = F.col("df") / total * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return counts.join(n, "session").select("session", "term", weight.alias("weight"))


def match(prints: DataFrame, session: int) -> DataFrame:
    """session, score, match of the threads that share a term with one: by its terms, whose number one session bounds."""
    norms = prints.groupBy("session").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    one = prints.where(F.col("session") == session).select("term", F.col("weight").alias("own"))
    dots = prints.where(F.col("session") != session).join(one, "term").groupBy("session").agg(F.sum(F.col("weight") * F.col("own")).alias("dot"))
    norm = norms.where(F.col("session") == session).select(F.col("norm").alias("q"))
    score = F.col("dot") / F.col("norm") / F.col("q")
    # norm is one row.
    rows = dots.join(norms, "session").join(F.broadcast(norm)).withColumn("s", score)
    return rows.select("session", F.round("s", 6).alias("score"), F.when(F.col("s") >= 0.55, "strong").when(F.col("s") >= 0.30, "weak").otherwise("none").alias("match"))
