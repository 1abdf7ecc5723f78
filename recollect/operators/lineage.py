"""What came of what: chains of supersession of any length and ancestors of kinds, safe against cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.graph import settled, unsettle


def chain(links: DataFrame, start: DataFrame, levels: int = 10_000) -> DataFrame:
    """start, id, position: what superseded each start (id), and what superseded that, in order; links are older, newer.

    A chain that comes back to an id it has passed ends there; a memory with several successors is followed to each. Where
    no memory has several, each round doubles the stretch that is known, so a chain of n takes log n joins; otherwise it is a
    recursive query for few starts, one level after the other.
    """
    if links.where("older is not null").groupBy("older").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _line(links, start)
    return links.sparkSession.sql(
        f"""with recursive chain(start, id, position, passed) max recursion level {levels} as (
          select id, id, 0, array(id) from {{start}}
          union all select c.start, l.newer, c.position + 1, array_append(c.passed, l.newer) from chain c join {{links}} l on l.older = c.id where not array_contains(c.passed, l.newer))
        select start, id, position from chain""",
        links=links, start=start,
    )


def _line(links: DataFrame, start: DataFrame) -> DataFrame:
    """chain() of links that give each memory one successor at most.

    A round knows the first 2^k places of each chain and what comes 2^k places after each memory. In a cycle the places go
    on, but bring no new id.
    """
    jump = settled(links.select("older", "newer"))
    found, size, stretch = settled(start.select(F.col("id").alias("start"), "id", F.lit(0).alias("position"))), -1, 1
    while (n := found.count()) != size:
        size = n
        further = found.join(jump, F.col("id") == F.col("older")).select("start", F.col("newer").alias("id"), (F.col("position") + stretch).alias("position"))
        grown = settled(found.unionByName(further).groupBy("start", "id").agg(F.min("position").alias("position")))
        on = jump.select(F.col("older").alias("newer"), F.col("newer").alias("to"))
        longer = settled(jump.join(on, "newer").select("older", F.col("to").alias("newer")))
        unsettle(found, jump)
        found, jump, stretch = grown, longer, 2 * stretch
    unsettle(jump)
    return found


def heads(links: DataFrame) -> DataFrame:
    """id, head, steps: for every superseded memory what stands at the end of its chain, and how far away that is.

    For whole tables: each round doubles the stretch that every memory looks ahead, so a chain of n takes log n joins.
    links (older, newer) give each memory one successor; memories that lead into a cycle have no head (null).
    """
    now = settled(links.select(F.col("older").alias("id"), F.col("newer").alias("head"), F.lit(1).cast("long").alias("steps")))
    n = now.count()
    ahead = now
    for _ in range(max(1, n).bit_length() + 1):
        on = now.select(F.col("id").alias("at"), F.col("head").alias("further"), F.col("steps").alias("more"))
        further = now.join(on, F.col("head") == F.col("at"), "left")
        ahead = settled(further.select("id", F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("at").isNotNull().alias("moved")))
        done = ahead.where("moved").isEmpty()
        unsettle(now)
        now = ahead
        if done:
            break
    looped = F.col("moved")
    return ahead.select("id", F.when(~looped, F.col("head")).alias("head"), F.when(~looped, F.col("steps")).alias("steps"))


def ancestors(edges: DataFrame, levels: int | None = None) -> DataFrame:
    """node, ancestor, depth: everything above a node (subject, object), at its smallest distance.

    Each round joins the pairs that are new with the edges; a pair met before isn't taken again, so cycles end.
    """
    up = edges.select(F.col("subject").alias("from"), F.col("object").alias("to")).distinct()
    front = settled(up.select(F.col("from").alias("node"), F.col("to").alias("ancestor"), F.lit(1).alias("depth")))
    found, parts = front, [front]
    while levels is None or len(parts) < levels:
        depth = len(parts) + 1
        new = front.join(up, F.col("ancestor") == F.col("from")).select("node", F.col("to").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        front = settled(new.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti").select("node", "ancestor", "depth"))
        if front.isEmpty():
            break
        parts.append(front)
        found = found.unionByName(front)
    return found
