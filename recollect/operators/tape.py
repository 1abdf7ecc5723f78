"""Event-sequence mining over a tape (event_id, session, tool, entity, failed, ts, cost), ordered by ts, event_id in each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def order() -> WindowSpec:
    """Each session's events in their order."""
    return Window.partitionBy("session").orderBy("ts", "event_id")


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 without trials."""
    p = successes / n
    return F.when(n == 0, 0.0).otherwise((p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def bigrams(tape: DataFrame) -> DataFrame:
    """The tape with the tool before each event."""
    return tape.withColumn("before", F.lag("tool").over(order()))


def pmi(tape: DataFrame) -> DataFrame:
    """before, tool, n, pmi: log(n(x, y) N / n(x) / n(y)) of tools that follow each other."""
    pairs = bigrams(tape).where("before is not null").groupBy("before", "tool").agg(F.count("*").alias("n"))
    # One row for each pair of tools: sums over them are small windows.
    total, x, y = Window.partitionBy(F.lit(0)), Window.partitionBy("before"), Window.partitionBy("tool")
    return pairs.select("before", "tool", "n", F.round(F.log(F.col("n") * F.sum("n").over(total) / F.sum("n").over(x) / F.sum("n").over(y)), 6).alias("pmi"))


def contexts(tape: DataFrame, n: int) -> DataFrame:
    """The tape with the n tools before each event, joined by '>'; rows with fewer are left out."""
    parts = [F.lag("tool", i).over(order()) for i in range(n, 0, -1)]
    return tape.withColumn("place", F.row_number().over(order())).withColumn("context", F.concat_ws(">", *parts)).where(F.col("place") > n)


def credit(tape: DataFrame, gain: float = 0.1, loss: float = 0.2, gamma: float = 0.9, reach: int = 16) -> DataFrame:
    """event_id, credit: discounted rewards of an event and the reach - 1 after it in its session."""
    ahead = order().rowsBetween(0, reach - 1)
    reward = F.when(F.col("failed") == 1, -loss).otherwise(gain)
    rewards = F.collect_list(reward).over(ahead)
    total = F.aggregate(F.reverse(rewards), F.lit(0.0), lambda s, r: s * gamma + r)
    return tape.select("event_id", F.round(total, 6).alias("credit"))


def best_sibling(contexts_: DataFrame, support: int) -> DataFrame:
    """context, taken, alternative, delta: for each entity in a context the one that fails least there, if that is less.

    One window a context, not all pairs of siblings.
    """
    by = contexts_.groupBy("context", "entity").agg(F.count("*").alias("n"), F.sum("failed").alias("fails")).where(F.col("n") >= support)
    by = by.withColumn("rate", F.col("fails") / F.col("n")).withColumn("sure", wilson(F.col("n") - F.col("fails"), F.col("n"), 1.645))
    best = Window.partitionBy("context").orderBy("rate", F.desc("sure"), "entity")
    rows = by.withColumn("alternative", F.first("entity").over(best)).withColumn("least", F.first("rate").over(best))
    return rows.where("rate > least").select("context", F.col("entity").alias("taken"), "alternative", F.round(F.col("rate") - F.col("least"), 6).alias("delta"))


def retries(tape: DataFrame, least: int, reach: int) -> DataFrame:
    """session, entity, opened, fails, escaped, injections of the stretches in which a command is tried again.

    Tries of one command are a stretch as long as each comes within reach events of the one before; a success ends it.
    """
    own = Window.partitionBy("session", "entity").orderBy("place")
    t = tape.withColumn("place", F.row_number().over(order()))
    gap, last = F.col("place") - F.lag("place").over(own), F.lag("tool").over(own)
    t = t.withColumn("new", F.when(gap.isNull() | (gap > reach) | (last == "purchase"), 1).otherwise(0))
    t = t.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    fails = F.count_if(F.col("tool") == "error")
    by = t.groupBy("session", "entity", "island").agg(F.min("place").cast("long").alias("opened"), fails.alias("fails"), F.bool_or(F.col("tool") == "purchase").alias("escaped"), F.count_if(F.col("tool") == "view").alias("injections"))
    return by.where(F.col("fails") >= least).drop("island")


def outcomes(injected: DataFrame, outcomes_: DataFrame, seconds: int) -> DataFrame:
    """item, injections, successes, failures, score: each injection's verdict from the outcomes of its session within a window behind it.

    injected is event_id, session, item, ts; outcomes_ is session, ts, exit_code (null if unknown), flagged. All known
    codes 0 and nothing flagged is a success; a code other than 0 of either sign, or a flag, is a failure; nothing known is
    no verdict. The window's length gives buckets, so the interval join is an equi-join on session and bucket.
    """
    bucket = lambda c: F.floor(micros(c) / (seconds * 1_000_000)).cast("long")
    left = injected.select("event_id", "session", "item", F.col("ts").alias("t0"), F.explode(F.array(bucket(F.col("ts")), bucket(F.col("ts")) + 1)).alias("bucket"))
    right = outcomes_.select("session", F.col("ts").alias("t1"), "exit_code", "flagged", bucket(F.col("ts")).alias("bucket"))
    gap = micros(F.col("t1")) - micros(F.col("t0"))
    hit = left.join(right, ["session", "bucket"]).where((gap >= 0) & (gap <= seconds * 1_000_000))
    seen = hit.groupBy("event_id").agg(F.count("exit_code").alias("known"), F.count_if(F.col("exit_code") != 0).alias("nonzero"), F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("flagged"))
    verdicts = injected.select("event_id", "item").join(seen, "event_id", "left")
    bad = (F.col("nonzero") > 0) | F.col("flagged")
    good = (F.col("known") > 0) & ~bad
    by = verdicts.groupBy("item").agg(F.count("*").alias("injections"), F.count_if(F.coalesce(good, F.lit(False))).alias("successes"), F.count_if(F.coalesce(bad, F.lit(False))).alias("failures"))
    score = F.greatest(F.lit(0.0), wilson(F.col("successes"), F.col("successes") + F.col("failures")))
    return by.withColumn("score", F.round(score, 6))
