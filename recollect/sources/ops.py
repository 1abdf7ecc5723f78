"""An op-log of write tools, derived from the event tape: each event is one operation of a tool on a subject.

It has the columns of the library's own log (operators/oplog.py), so views read either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.oplog import FAMILY
from recollect.sources.tables import table

#: Subjects, and the tools that work on them.
SUBJECTS = {
    "memory": "pin_memory unpin_memory memory_lock memory_unlock set_evidence_type propose_change approve_memory reject_memory memory_outcome log_exposure strengthen weaken",
    "task": "register_task update_task add_delegation link_evidence add_probe set_criterion long_task_start long_task_event long_task_update long_task_complete",
    "project": "ledger_save ledger_append checkpoint",
    "agent": "agent_upsert agent_disable msg_send msg_respond narrative_log session_heartbeat",
    "goal": "goal_set goal_progress goal_complete",
    "profile": "profile_update profile_observe",
    "skill": "skill_upload skill_deprecate",
    "trigger": "trigger_add trigger_fire trigger_dismiss",
    "intervention": "start_intervention add_observation record_attribution close_intervention",
    "debt": "register_debt defer_debt resolve_debt attach_debt_evidence record_surprise",
    "lineage": "enroll_wisdom_lineage transition_wisdom_lineage tick_lineage_staleness close_rederive",
    "candidate": "upsert_wisdom_candidate update_wisdom_lifecycle",
    "gap": "curiosity_note_gap curiosity_resolve research_store",
    "symbol": "log_event log_event_ex log_decision learn_correction",
}
TOOLS = [(tool, subject) for subject, tools in SUBJECTS.items() for tool in tools.split()]
TARGETS = 12  #: subjects of a kind


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_id, family, tool, target, actor, args (amount, kind, ref), ts."""
    events = table(spark, sf_dir, "events").where("ts is not null and user_id is not null and get_json_object(props, '$.k') is not null")
    rows = events.select("event_id", "user_id", "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    rows = rows.withColumn("at", ((F.col("event_id") * 31 + F.col("k")) % len(TOOLS) + 1).cast("int"))
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("at"))
    args = F.map_filter(F.create_map(F.lit("amount"), F.col("value").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("ref"), F.col("k").cast("string")), lambda _, v: v.isNotNull())
    target = F.concat_ws(":", of([s for _, s in TOOLS]), (F.col("k") % TARGETS).cast("string"))
    return rows.select(
        F.col("event_id").cast("string").alias("op_id"), of([FAMILY[t] for t, _ in TOOLS]).alias("family"), of([t for t, _ in TOOLS]).alias("tool"), target.alias("target"),
        F.concat(F.lit("agent:"), F.col("user_id").cast("string")).alias("actor"), args.alias("args"), F.col("ts").cast("timestamp").alias("ts"),
    )
