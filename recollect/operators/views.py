"""Views of the op-log: what each tool of state reads, as functions of any frame with the log's columns.

State is the latest operation of a key, a count or a sum over its operations; each is one aggregation keyed by its
subject, combined before the shuffle, or a window within one subject. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.oplog import latest


def arg(name: str) -> Column:
    return F.try_element_at("args", F.lit(name))


def us() -> Column:
    return F.unix_micros("ts")


def of(ops: DataFrame, *tools: str) -> DataFrame:
    return ops.where(F.col("tool").isin(*tools))


def states(ops: DataFrame, names: dict[str, str], *keys: str) -> DataFrame:
    """The latest of some tools' operations for each key, with a column state: what that tool leaves the key in."""
    state = F.lit(None).cast("string")
    for tool, name in names.items():
        state = F.when(F.col("tool") == tool, name).otherwise(state)
    return latest(of(ops, *names), *keys).withColumn("state", state)


def tally(ops: DataFrame, names: dict[str, str], *keys: str) -> DataFrame:
    """For each key (target) with such an operation, how many there are of each tool, in columns of the names given."""
    return of(ops, *names).groupBy(*(keys or ("target",))).agg(*(F.count_if(F.col("tool") == t).alias(n) for t, n in names.items()))


def newest(ops: DataFrame, k: int | None, *keys: str) -> DataFrame:
    """The k newest operations (all if None), of each key if there are keys, with their place."""
    order = (F.desc("ts"), F.desc("op_id"))
    if not keys:
        return ops.orderBy(*order).limit(k)
    rows = ops.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows if k is None else rows.where(F.col("place") <= k)


def versions(ops: DataFrame, tool: str) -> DataFrame:
    """Every operation of a tool with its number, from 1, among those on its target, and how many there are."""
    own = Window.partitionBy("target")
    return of(ops, tool).withColumn("version", F.row_number().over(own.orderBy("ts", "op_id")).cast("long")).withColumn("versions", F.count("*").over(own))


def locks(ops: DataFrame, now: Column) -> DataFrame:
    """target, holder, state (held, expired, released) of everything that was locked; a lock runs out after its amount in hours."""
    last = latest(of(ops, "memory_lock", "memory_unlock"))
    ends = us() + (F.coalesce(arg("amount").cast("double"), F.lit(1.0)) * 3_600_000_000).cast("long")
    state = F.when(F.col("tool") == "memory_unlock", "released").when(ends <= now, "expired").otherwise("held")
    return last.select("target", F.col("actor").alias("holder"), state.alias("state"))


def progress(ops: DataFrame, whole: float) -> DataFrame:
    """target, progress (0 to 1), status of goals that were set: sums of what progressed since they were last set."""
    begun = latest(of(ops, "goal_set")).select("target", F.col("ts").alias("begun"))
    since = of(ops, "goal_progress", "goal_complete").join(begun, "target").where(F.col("ts") >= F.col("begun"))
    amount = F.when(F.col("tool") == "goal_progress", F.coalesce(arg("amount").cast("double"), F.lit(0.0))).otherwise(0.0)
    done = since.groupBy("target").agg(F.sum(amount).alias("amount"), F.max(F.col("tool") == "goal_complete").alias("done"))
    share = F.least(F.lit(1.0), F.coalesce("amount", F.lit(0.0)) / whole)
    return begun.join(done, "target", "left").select("target", F.round(share, 6).alias("progress"), F.when(F.coalesce("done", F.lit(False)) | (share >= 1), "complete").otherwise("open").alias("status"))


def debts(ops: DataFrame) -> DataFrame:
    """target, status, fragility, evidence of every debt: fragility is the mean amount of its evidence in hundredths, 0 without."""
    status = states(ops, {"register_debt": "open", "defer_debt": "deferred", "resolve_debt": "resolved"}).select("target", F.col("state").alias("status"))
    amount = F.coalesce(arg("amount").cast("double"), F.lit(0.0)) / 100
    proof = of(ops, "attach_debt_evidence").groupBy("target").agg(F.avg(amount).alias("f"), F.count("*").alias("evidence"))
    return status.join(proof, "target", "left").select("target", "status", F.round(F.coalesce("f", F.lit(0.0)), 6).alias("fragility"), F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"))


def lineages(ops: DataFrame) -> DataFrame:
    """target, state, support, contradiction, last (microseconds) of every lineage: the latest transition's kind, or enrolled."""
    seen = of(ops, "enroll_wisdom_lineage", "transition_wisdom_lineage")
    moved = F.col("tool") == "transition_wisdom_lineage"
    last = F.max(F.when(moved, F.struct("ts", "op_id", arg("kind").alias("kind"))))
    by = seen.groupBy("target").agg(last.alias("last"), F.count_if(moved & (arg("kind") == "purchase")).alias("support"), F.count_if(moved & (arg("kind") == "error")).alias("contradiction"), F.max(us()).alias("us"))
    return by.select("target", F.coalesce("last.kind", F.lit("enrolled")).alias("state"), "support", "contradiction", F.col("us").alias("last"))


def segments(ops: DataFrame) -> DataFrame:
    """actor, mode, n, first (microseconds) of the present stretch of each actor's work of one kind."""
    own = Window.partitionBy("actor").orderBy(F.desc("ts"), F.desc("op_id"))
    rows = of(ops, "narrative_log").withColumn("mode", arg("kind"))
    rows = rows.withColumn("other", F.sum((F.coalesce("mode", F.lit("")) != F.coalesce(F.first("mode").over(own), F.lit(""))).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("other = 0").groupBy("actor", "mode").agg(F.count("*").alias("n"), F.min(us()).alias("first"))


def snapshot(ops: DataFrame, budget: float) -> DataFrame:
    """target, op_id, spent: the operations on each task, newest first, while their amounts fit a budget."""
    own = Window.partitionBy("target").orderBy(F.desc("ts"), F.desc("op_id")).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.coalesce(arg("amount").cast("double"), F.lit(0.0))).over(own)
    return of(ops, "long_task_start", "long_task_event", "long_task_update", "long_task_complete").withColumn("spent", F.round(spent, 4)).where(F.col("spent") <= budget).select("target", "op_id", "spent")


def useful(ops: DataFrame) -> DataFrame:
    """day, exposures, useful: memories shown on a day, and those of them that had a good outcome (purchase) on that day."""
    day = F.floor(us() / 86_400_000_000).alias("day")
    shown = of(ops, "log_exposure").select("target", day).distinct()
    good = of(ops, "memory_outcome").where(arg("kind") == "purchase").select("target", day, F.lit(1).alias("good")).distinct()
    return shown.join(good, ["target", "day"], "left").groupBy("day").agg(F.count("*").alias("exposures"), F.count("good").alias("useful"))
