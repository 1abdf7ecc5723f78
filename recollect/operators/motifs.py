"""Motifs of a tape: the contexts of any length that recur, as the states of a suffix automaton, and what they are worth.

Contexts grow by one symbol a round: those of n + 1 symbols come from joining those of n that recur with the ones one place
before, so a context is only looked at if both its parts recur. Contexts with the same end positions are one
state, told by its longest context. A state's value follows the rewards at its end positions in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.graph import settled

SEPARATOR = ">"


def occurrences(tape: DataFrame, depth: int, support: int = 2) -> DataFrame:
    """gram, n, size, session, place, reward, after of every occurrence of a context of up to depth symbols that occurs so often at least.

    tape is session, place (1, 2, ... within the session), symbol, reward.
    """
    own = Window.partitionBy("session").orderBy("place")
    base = settled(tape.select("session", "place", "symbol", "reward", F.lead("symbol").over(own).alias("after")))
    level = base.withColumn("gram", F.col("symbol"))
    found = None
    for n in range(1, depth + 1):
        sizes = level.groupBy("gram").agg(F.count("*").alias("size")).where(F.col("size") >= support)
        kept = settled(level.join(sizes, "gram").select("gram", F.lit(n).alias("n"), "size", "session", "place", "symbol", "reward", "after"))
        found = kept if found is None else found.unionByName(kept)
        if n == depth or kept.isEmpty():
            break
        # Merged: a table of grams is small as a file, but a row for each place once it is read, too many to be broadcast.
        before = kept.select("session", (F.col("place") + 1).alias("place"), F.col("gram").alias("first"))
        level = kept.drop("gram", "n", "size").join(before.hint("merge"), ["session", "place"]).withColumn("gram", F.concat_ws(SEPARATOR, "first", "symbol"))
    return found.drop("symbol")


def states(found: DataFrame, rate: float = 0.5) -> DataFrame:
    """context, n, size, q, score, after, support of every state of occurrences().

    q is what TD(0) makes of the rewards at the state's end positions, in their order, from 0: each moves it by rate / size of the
    difference, so general states, which have many, don't follow single ones. score is q from 0 to 1. after is the
    most frequent next symbol, support how often it comes.
    """
    # A context is the longest of its state unless one symbol before it is the same at all its occurrences.
    longer = found.where("n > 1").groupBy(F.substring_index("gram", SEPARATOR, 1).alias("first"), "gram", "n", "size").agg(F.lit(1).alias("one"))
    longer = longer.select(F.expr("substring(gram, length(first) + 2)").alias("gram"), (F.col("n") - 1).alias("n"), F.col("size").alias("held"))
    covered = longer.groupBy("gram", "n").agg(F.max("held").alias("held"))
    rows = found.join(covered, ["gram", "n"], "left").where("held is null or held < size")
    # Rank of an end position in two levels, as a short context may end at a large share of the tape.
    sessions = rows.groupBy("gram", "session").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("gram").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("within", F.row_number().over(Window.partitionBy("gram", "session").orderBy("place"))).join(sessions.select("gram", "session", before.alias("earlier")).hint("merge"), ["gram", "session"])
    pace = F.lit(rate) / F.col("size")
    part = F.col("reward") * pace * F.pow(1 - pace, F.col("size") - F.col("earlier") - F.col("within"))
    values = ranked.groupBy("gram", "n", "size").agg(F.sum(part).alias("q"))
    next_ = rows.where("after is not null").groupBy("gram", "after").agg(F.count("*").alias("support"))
    most = next_.groupBy("gram").agg(F.min(F.struct((-F.col("support")).alias("less"), "after")).alias("m"))
    told = values.join(most, "gram", "left")
    return told.select(F.col("gram").alias("context"), "n", "size", F.round("q", 6).alias("q"), F.round((F.col("q") + 1) / 2, 6).alias("score"), F.col("m.after").alias("after"), (-F.col("m.less")).alias("support"))
