"""Writes as an append-only log of operations, and views that read its latest rows.

Every write tool appends one row: family, tool, target, actor, args and time. Nothing is updated in place: a view
takes each target's latest row (or a signed sum), so any earlier state can be read as of a time, and rows that a
restart appends again count once by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "op_id string, family string, tool string, target string, actor string, args map<string,string>, ts timestamp"

# Names of the write tools, by family.
TOOLS = {
    "memory": "ack_memory approve_memory create_episode forget forget_kind mark_memory_invalidated memory_edit memory_lock memory_outcome memory_unlock nack_memory pin_memory promote_memory propose_change prune_episodes reject_memory remember remember_batch remember_typed resolve_merge set_affect set_evidence_type set_memory_type set_priority_tier strengthen tag unpin_memory update verify_correction weaken stageb_set_surface batch_forget reembed_memories witness_memory",
    "graph": "assoc_decay connect connect_temporal grow triplet_supersede predicate_attach",
    "code": "embed_symbols learn_codebase clear_codebase dedupe_symbols describe_symbol restore_code_intel_confidence file_index_all file_index_session",
    "session": "checkpoint observe ledger_delete ledger_save ledger_append ledger_compile long_task_complete long_task_event long_task_start long_task_update session_sync session_register session_deregister session_heartbeat msg_ack_all msg_respond msg_send msg_ack log_decision log_exposure narrative_log transcript_register transcript_remove transcript_update",
    "realm": "realm_add realm_remove realm_set realm_visibility remap_realms trim_realm_names",
    "upkeep": "densify_backfill rebuild_fts_index semantic_backfill consolidate_similar consolidation_pass consolidation_auto consolidation_merge disable_source reconsolidate resolve_contradiction save_spectral_snapshot cleanup hygiene_run reconcile_pass import_soul ingest_source queue_experiments",
    "evidence": "calibration_record probe_calibrate probe_seed span_backfill span_backfill_memories add_probe link_evidence resolve_probe set_criterion assert_fact branch_create branch_resolve retract_fact",
    "learning": "curiosity_note_gap curiosity_resolve research_store learn learn_analysis learn_approach learn_correction learn_insight learn_milestone learn_outcome learn_preference record_feedback update_scorer_model update_source_weight suggestion_resolve suggestion_track",
    "habit": "anticipation_observe anticipation_success anticipation_record_outcome habit_observe habit_strengthen habit_weaken trigger_add trigger_dismiss trigger_fire",
    "goal": "goal_complete goal_progress goal_set profile_observe profile_update",
    "agent": "add_delegation agent_disable agent_upsert register_task skill_deprecate skill_upload update_task",
    "intervention": "add_observation close_intervention record_attribution start_intervention",
    "debt": "attach_debt_evidence defer_debt record_surprise register_debt resolve_debt",
    "wisdom": "close_rederive enroll_wisdom_lineage insight_promote tick_lineage_staleness transition_wisdom_lineage update_wisdom_lifecycle upsert_wisdom_candidate",
    "episode": "executor_flush log_event log_event_ex",
}
FAMILY = {tool: family for family, names in TOOLS.items() for tool in names.split()}


def append(spark: SparkSession, folder: str, rows: list[tuple] | DataFrame) -> None:
    """Append operations (op_id, tool, target, actor, args, ts); a tool that isn't known is refused before anything is written."""
    given = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, "op_id string, tool string, target string, actor string, args map<string,string>, ts timestamp")
    families = spark.createDataFrame(sorted(FAMILY.items()), "tool string, family string")
    # As many rows as there are tools.
    known = given.join(F.broadcast(families), "tool", "left").withColumn("family", F.coalesce("family", F.raise_error(F.concat(F.lit("no such write: "), F.col("tool"))).cast("string")))
    known.select("op_id", "tool", "target", "actor", "args", "ts", "family").write.mode("append").partitionBy("family").parquet(folder)


def read(spark: SparkSession, folder: str, family: str | None = None, as_of: str | None = None) -> DataFrame:
    """The log, each operation once; only the family's partition and only rows up to a time if asked for."""
    ops = spark.read.schema(SCHEMA).parquet(folder)
    if family is not None:
        ops = ops.where(F.col("family") == family)
    if as_of is not None:
        ops = ops.where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    return ops.dropDuplicates(["op_id"])


def latest(ops: DataFrame, *keys: str) -> DataFrame:
    """The latest row of each key; ties by op_id."""
    keys = keys or ("target",)
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("op_id"))
    return ops.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def standing(ops: DataFrame, on: str, off: str) -> DataFrame:
    """Targets whose last operation of the two is the one that sets (pins, locks, tags, registrations)."""
    return latest(ops.where(F.col("tool").isin(on, off))).where(F.col("tool") == on).select("target", "actor", "ts")


def amounts(ops: DataFrame, signs: dict[str, float], base: float = 0.0) -> DataFrame:
    """target, amount: a signed sum of args['amount'] (1 without), from a base; combined before the shuffle."""
    sign = F.lit(0.0)
    for tool, s in signs.items():
        sign = F.when(F.col("tool") == tool, s).otherwise(sign)
    amount = F.coalesce(F.try_element_at("args", F.lit("amount")).cast("double"), F.lit(1.0))
    return ops.where(F.col("tool").isin(*signs)).groupBy("target").agg((F.lit(base) + F.sum(sign * amount)).alias("amount"))
