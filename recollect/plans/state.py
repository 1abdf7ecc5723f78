"""Registered queries over the op-log: what tools of state read, by the views of operators/views.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import views as V
from recollect.operators.oplog import latest, standing
from recollect.plans.registry import query
from recollect.sources.ops import TARGETS, TOOLS, ops
from recollect.sources.tables import turns

_AT = f"(event_id * 31 + k) % {len(TOOLS)} + 1"
_OPS = (
    f"(select event_id::varchar op_id, [{','.join(repr(t) for t, _ in TOOLS)}][{_AT}] tool, [{','.join(repr(s) for _, s in TOOLS)}][{_AT}] || ':' || (k % {TARGETS}) target, "
    "'agent:' || user_id actor, value amount, event_type kind, k::varchar as ref, epoch_us(ts) us from (select *, (props->>'$.k')::bigint k from events) where ts is not null and user_id is not null and k is not null)"
)
_NEW = "us desc, op_id desc"


def _in(*tools: str) -> str:
    return "tool in (" + ",".join(repr(t) for t in tools) + ")"


def _last(*tools: str, by: str = "target") -> str:
    """The latest of some tools' rows of each key, as SQL."""
    return f"(select * from {_OPS} where {_in(*tools)} qualify row_number() over (partition by {by} order by {_NEW}) = 1)"


def _now(o: DataFrame) -> Column:
    """The latest time of the log: a scalar subquery of one row."""
    return o.agg(F.max(V.us())).scalar()


@query(f"select target, actor, us from {_last('pin_memory', 'unpin_memory')} where tool = 'pin_memory'")
def list_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that are pinned, by whom and since when."""
    return standing(ops(spark, sf_dir), "pin_memory", "unpin_memory").select("target", "actor", V.us().alias("us"))


@query(f"select target, actor holder, case when tool = 'memory_unlock' then 'released' when us + (coalesce(amount, 1.0) * 3600000000)::bigint <= (select max(us) from {_OPS}) then 'expired' else 'held' end state from {_last('memory_lock', 'memory_unlock')}")
def memory_lock_status(spark: SparkSession, sf_dir: str, now: int | None = None) -> DataFrame:
    """Holder and state of every lock at a time (the log's last one)."""
    o = ops(spark, sf_dir)
    return V.locks(o, _now(o) if now is None else F.lit(now))


@query(f"select target, kind evidence from {_last('set_evidence_type')}")
def get_evidence_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence type of every memory that has one."""
    return latest(V.of(ops(spark, sf_dir), "set_evidence_type")).select("target", V.arg("kind").alias("evidence"))


@query(f"select count(*) staged, min(us) oldest from {_last('propose_change', 'approve_memory', 'reject_memory')} where tool = 'propose_change'")
def write_gate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that wait for approval, and since when the oldest does."""
    found = V.states(ops(spark, sf_dir), {"propose_change": "staged", "approve_memory": "approved", "reject_memory": "rejected"})
    return found.where("state = 'staged'").agg(F.count("*").alias("staged"), F.min(V.us()).alias("oldest"))


@query(f"select target, case tool when 'trigger_add' then 'armed' when 'trigger_fire' then 'fired' else 'dismissed' end state from {_last('trigger_add', 'trigger_fire', 'trigger_dismiss')}")
def trigger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trigger with its state."""
    return V.states(ops(spark, sf_dir), {"trigger_add": "armed", "trigger_fire": "fired", "trigger_dismiss": "dismissed"}).select("target", "state")


_GOALS = f"""(select target, round(least(1.0, coalesce(amount, 0) / 200), 6) progress, case when coalesce(done, false) or coalesce(amount, 0) / 200 >= 1 then 'complete' else 'open' end status from
  (select b.target, sum(case when o.tool = 'goal_progress' then coalesce(o.amount, 0) else 0 end) amount, bool_or(o.tool = 'goal_complete') done from {_last('goal_set')} b left join {_OPS} o on o.target = b.target and {_in('goal_progress', 'goal_complete').replace('tool', 'o.tool')} and o.us >= b.us group by b.target))"""


@query(f"select * from {_GOALS}")
def goal_list(spark: SparkSession, sf_dir: str, whole: float = 200.0) -> DataFrame:
    """Goals with their progress and status."""
    return V.progress(ops(spark, sf_dir), whole)


@query(f"select * from {_GOALS} where target = 'goal:3'")
def goal_get(spark: SparkSession, sf_dir: str, goal: str = "goal:3", whole: float = 200.0) -> DataFrame:
    """One goal; the filter reaches the scan of the log."""
    return V.progress(ops(spark, sf_dir).where(F.col("target") == goal), whole)


@query(f"select target, kind field, ref as value from {_last('profile_update', by='target, kind')}")
def profile_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of every field of each profile."""
    own = V.of(ops(spark, sf_dir), "profile_update").withColumn("field", V.arg("kind"))
    return latest(own, "target", "field").select("target", "field", V.arg("ref").alias("value"))


@query(f"select target, case tool when 'agent_upsert' then 'active' else 'disabled' end state, kind as role from {_last('agent_upsert', 'agent_disable')}")
def agent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered agents with their state and role."""
    return V.states(ops(spark, sf_dir), {"agent_upsert": "active", "agent_disable": "disabled"}).select("target", "state", V.arg("kind").alias("role"))


_AGENT = {"agent_upsert": "registrations", "session_heartbeat": "heartbeats", "msg_send": "sent"}


@query(f"select target, count(*) filter (tool = 'agent_upsert') registrations, count(*) filter (tool = 'session_heartbeat') heartbeats, count(*) filter (tool = 'msg_send') sent from {_OPS} where target = 'agent:3' and {_in(*_AGENT)} group by target")
def agent_get(spark: SparkSession, sf_dir: str, agent: str = "agent:3") -> DataFrame:
    """One agent's record."""
    return V.tally(ops(spark, sf_dir).where(F.col("target") == agent), _AGENT)


_TASK = {"add_delegation": "delegations", "link_evidence": "evidence", "add_probe": "probes", "set_criterion": "criteria"}
_COUNTS = ", ".join(f"count(*) filter (tool = '{t}') {n}" for t, n in _TASK.items())


@query(f"select count(distinct target) filter (tool = 'register_task') tasks, {_COUNTS} from {_OPS}")
def agent_protocol_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the five tables of the agents' protocol."""
    own = V.of(ops(spark, sf_dir), "register_task", *_TASK)
    return own.agg(F.countDistinct(F.when(F.col("tool") == "register_task", F.col("target"))).alias("tasks"), *(F.count_if(F.col("tool") == t).alias(n) for t, n in _TASK.items()))


@query(f"select s.target, s.kind status, coalesce(delegations, 0) delegations, coalesce(evidence, 0) evidence, coalesce(probes, 0) probes, coalesce(criteria, 0) criteria from {_last('register_task', 'update_task')} s left join (select target, {_COUNTS} from {_OPS} where {_in(*_TASK)} group by target) c using (target)")
def get_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task with its status and what its contract holds."""
    o = ops(spark, sf_dir)
    status = V.states(o, {"register_task": "registered", "update_task": "updated"}).select("target", V.arg("kind").alias("status"))
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in _TASK.values()]
    return status.join(V.tally(o, _TASK), "target", "left").select("target", "status", *zero)


@query(f"select target, kind status from {_last('register_task', 'update_task')} where kind in ('view', 'click') and target in (select target from {_OPS} where tool = 'add_probe')")
def query_tasks(spark: SparkSession, sf_dir: str, status: tuple[str, ...] = ("view", "click"), having: str = "add_probe") -> DataFrame:
    """Tasks in some states that have an operation of a kind."""
    o = ops(spark, sf_dir)
    found = latest(V.of(o, "register_task", "update_task")).select("target", V.arg("kind").alias("status")).where(F.col("status").isin(*status))
    return found.join(V.of(o, having).select("target"), "target", "left_semi")


@query(f"select u.target, u.versions, coalesce(d.us > u.us, false) deprecated from (select target, count(*) versions, max(us) us from {_OPS} where tool = 'skill_upload' group by target) u left join (select target, max(us) us from {_OPS} where tool = 'skill_deprecate' group by target) d using (target)")
def skill_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills with the number of their versions, and whether the last one was deprecated since."""
    own = V.of(ops(spark, sf_dir), "skill_upload", "skill_deprecate")
    at = lambda t: F.max(F.when(F.col("tool") == t, V.us()))
    by = own.groupBy("target").agg(F.count_if(F.col("tool") == "skill_upload").alias("versions"), F.coalesce(at("skill_deprecate") > at("skill_upload"), F.lit(False)).alias("deprecated"))
    return by.where("versions > 0")


@query(f"select target, version, op_id from (select target, op_id, row_number() over (partition by target order by us, op_id) as version, count(*) over (partition by target) n from {_OPS} where tool = 'skill_upload') where version = n")
def skill_read(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """A version of every skill; 0 is the latest."""
    rows = V.versions(ops(spark, sf_dir), "skill_upload")
    return rows.where(F.col("version") == (F.col("versions") if version == 0 else F.lit(version))).select("target", "version", "op_id")


_OUTCOME = "case kind when 'purchase' then 'succeeded' when 'error' then 'failed' else 'aborted' end"


def _outcome() -> Column:
    return F.when(V.arg("kind") == "purchase", "succeeded").when(V.arg("kind") == "error", "failed").otherwise("aborted")


@query(f"select target, count(*) filter (tool = 'add_observation') observations, count(*) filter (tool = 'record_attribution') attributions, count(*) filter (tool = 'close_intervention') closings from {_OPS} where target = 'intervention:5' and {_in('add_observation', 'record_attribution', 'close_intervention')} group by target")
def get_intervention(spark: SparkSession, sf_dir: str, intervention: str = "intervention:5") -> DataFrame:
    """One intervention with what was recorded on it."""
    return V.tally(ops(spark, sf_dir).where(F.col("target") == intervention), {"add_observation": "observations", "record_attribution": "attributions", "close_intervention": "closings"})


_INTERVENTIONS = f"(select target, actor, case when tool = 'start_intervention' then 'open' else {_OUTCOME} end state, us from {_last('start_intervention', 'close_intervention')})"


def _interventions(o: DataFrame) -> DataFrame:
    found = V.states(o, {"start_intervention": "open", "close_intervention": "closed"})
    return found.withColumn("state", F.when(F.col("state") == "open", "open").otherwise(_outcome()))


@query(f"select state, count(*) n from {_INTERVENTIONS} group by state")
def intervention_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions by outcome."""
    return _interventions(ops(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query(f"select target, actor, us from {_INTERVENTIONS} where state = 'open'")
def list_open_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions that were started and not closed since."""
    return _interventions(ops(spark, sf_dir)).where("state = 'open'").select("target", "actor", V.us().alias("us"))


@query(f"select target, state from {_INTERVENTIONS} where state in ('failed', 'aborted')")
def query_interventions(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = ("failed", "aborted")) -> DataFrame:
    """Interventions in some states."""
    return _interventions(ops(spark, sf_dir)).where(F.col("state").isin(*wanted)).select("target", "state")


_DEBTS = f"""(select s.target, case s.tool when 'register_debt' then 'open' when 'defer_debt' then 'deferred' else 'resolved' end status, round(coalesce(f, 0), 6) fragility, coalesce(evidence, 0) evidence
  from {_last('register_debt', 'defer_debt', 'resolve_debt')} s left join (select target, avg(coalesce(amount, 0) / 100) f, count(*) evidence from {_OPS} where tool = 'attach_debt_evidence' group by target) using (target))"""


@query(f"select status, count(*) n, round(avg(fragility), 5) fragility from {_DEBTS} group by status")
def debt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debts by status with their mean fragility."""
    return V.debts(ops(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("fragility"), 5).alias("fragility"))


@query(f"select * from {_DEBTS} where status <> 'resolved' and fragility >= 0.1")
def query_debts(spark: SparkSession, sf_dir: str, least: float = 0.1) -> DataFrame:
    """Debts that aren't resolved and fragile enough."""
    return V.debts(ops(spark, sf_dir)).where((F.col("status") != "resolved") & (F.col("fragility") >= least))


@query(f"select target, fragility from {_DEBTS} where status = 'open' order by fragility desc, target limit 20")
def get_fragile_decisions(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The most fragile open debts."""
    return V.debts(ops(spark, sf_dir)).where("status = 'open'").orderBy(F.desc("fragility"), "target").limit(k).select("target", "fragility")


@query(f"select kind as domain, target, count(*) n, round(avg(amount), 4) magnitude from {_OPS} where tool = 'record_surprise' and amount >= 30 group by all having count(*) >= 2")
def get_blind_spots(spark: SparkSession, sf_dir: str, least: float = 30.0, times: int = 2) -> DataFrame:
    """What surprised much, and more than once, in a domain."""
    amount = V.arg("amount").cast("double")
    rows = V.of(ops(spark, sf_dir), "record_surprise").where(amount >= least).groupBy(V.arg("kind").alias("domain"), "target")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(amount), 4).alias("magnitude")).where(F.col("n") >= times)


_LINEAGES = f"(select target, coalesce(arg_max(kind, (us, op_id)) filter (tool = 'transition_wisdom_lineage'), 'enrolled') state, count(*) filter (tool = 'transition_wisdom_lineage' and kind = 'purchase') support, count(*) filter (tool = 'transition_wisdom_lineage' and kind = 'error') contradiction, max(us) as \"last\" from {_OPS} where {_in('enroll_wisdom_lineage', 'transition_wisdom_lineage')} group by target)"


@query(f"select state, count(*) n, sum(support)::bigint support, sum(contradiction)::bigint contradiction from {_LINEAGES} group by state")
def wisdom_lineage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages by state."""
    return V.lineages(ops(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"), F.sum("support").alias("support"), F.sum("contradiction").alias("contradiction"))


@query(f"select target, state from {_LINEAGES} where contradiction >= support")
def query_wisdom_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages that are contradicted as often as supported."""
    return V.lineages(ops(spark, sf_dir)).where("contradiction >= support").select("target", "state")


@query(f"select * from {_LINEAGES} where target = 'lineage:4'")
def get_wisdom_lineage(spark: SparkSession, sf_dir: str, lineage: str = "lineage:4") -> DataFrame:
    """One lineage."""
    return V.lineages(ops(spark, sf_dir).where(F.col("target") == lineage))


@query(f"select l.target, l.us from {_last('transition_wisdom_lineage')} l where l.us < (select max(us) from {_OPS}) - 21600000000 and not exists (select 1 from {_OPS} c where c.tool = 'close_rederive' and c.target = l.target and c.us >= l.us)")
def lineage_expiry_check(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Lineages whose last transition is too long ago and hasn't been derived anew since."""
    o = ops(spark, sf_dir)
    last = latest(V.of(o, "transition_wisdom_lineage")).select("target", V.us().alias("us"))
    closed = V.of(o, "close_rederive").groupBy("target").agg(F.max(V.us()).alias("closed"))
    stale = last.where(F.col("us") < _now(o) - hours * 3_600_000_000).join(closed, "target", "left")
    return stale.where("closed is null or closed < us").select("target", "us")


_STAGES = f"(select target, case when tool = 'upsert_wisdom_candidate' then 'candidate' else kind end stage from {_last('upsert_wisdom_candidate', 'update_wisdom_lifecycle')})"


def _stages(o: DataFrame) -> DataFrame:
    found = V.states(o, {"upsert_wisdom_candidate": "candidate", "update_wisdom_lifecycle": "moved"})
    return found.select("target", F.when(F.col("state") == "candidate", "candidate").otherwise(V.arg("kind")).alias("stage"))


@query(f"select target from {_STAGES} where stage in ('candidate', 'view', 'signup')")
def query_wisdom_candidates(spark: SparkSession, sf_dir: str, stages: tuple[str, ...] = ("candidate", "view", "signup")) -> DataFrame:
    """Wisdom candidates in some stages."""
    return _stages(ops(spark, sf_dir)).where(F.col("stage").isin(*stages)).select("target")


@query(f"select stage, count(*) n from {_STAGES} group by stage")
def wisdom_promotion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wisdom candidates in each stage."""
    return _stages(ops(spark, sf_dir)).groupBy("stage").agg(F.count("*").alias("n"))


@query(f"select op_id, target, actor from {_OPS} where {_in('ledger_save', 'checkpoint')} order by {_NEW} limit 50")
def ledger_list(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """The newest checkpoints of all projects."""
    return V.newest(V.of(ops(spark, sf_dir), "ledger_save", "checkpoint"), k).select("op_id", "target", "actor")


@query(f"select target, actor, op_id from {_last('ledger_save', 'checkpoint')}")
def ledger_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest checkpoint of every project."""
    return latest(V.of(ops(spark, sf_dir), "ledger_save", "checkpoint")).select("target", "actor", "op_id")


@query(f"select op_id, tool, actor from {_OPS} where target = 'project:5' and {_in('ledger_save', 'ledger_append', 'checkpoint')}")
def ledger_get(spark: SparkSession, sf_dir: str, project: str = "project:5") -> DataFrame:
    """One project's ledger."""
    return V.of(ops(spark, sf_dir).where(F.col("target") == project), "ledger_save", "ledger_append", "checkpoint").select("op_id", "tool", "actor")


@query(f"select tool, count(*) n, count(*) - count(amount) without_amount, min(us) as first_us, max(us) as last_us from {_OPS} group by tool")
def ledger_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every tool, how many lack an amount, and their first and last time."""
    return ops(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("n"), (F.count("*") - F.count(V.arg("amount"))).alias("without_amount"), F.min(V.us()).alias("first_us"), F.max(V.us()).alias("last_us"))


@query(f"select op_id, target, amount from {_OPS} where tool = 'ledger_append' and amount >= 10")
def ledger_query(spark: SparkSession, sf_dir: str, tool: str = "ledger_append", least: float = 10.0) -> DataFrame:
    """Operations of a tool with an amount of so much at least."""
    amount = V.arg("amount").cast("double")
    return V.of(ops(spark, sf_dir), tool).where(amount >= least).select("op_id", "target", amount.alias("amount"))


_LONG = ("long_task_start", "long_task_event", "long_task_update", "long_task_complete")


@query(f"select target, actor, us from {_last(*_LONG)} where tool <> 'long_task_complete'")
def long_task_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that were worked on and not completed since."""
    return latest(V.of(ops(spark, sf_dir), *_LONG)).where("tool <> 'long_task_complete'").select("target", "actor", V.us().alias("us"))


@query(f"select target, tool, count(*) n, max(us) as last_us from {_OPS} where target = 'task:5' and {_in(*_LONG)} group by target, tool")
def long_task_get(spark: SparkSession, sf_dir: str, task: str = "task:5") -> DataFrame:
    """One task's operations of each kind."""
    return V.of(ops(spark, sf_dir).where(F.col("target") == task), *_LONG).groupBy("target", "tool").agg(F.count("*").alias("n"), F.max(V.us()).alias("last_us"))


@query(f"select target, count(*) filter (kind = 'purchase') satisfied, count(*) checks, round(count(*) filter (kind = 'purchase') / count(*)::double, 6) share from {_OPS} where tool = 'long_task_event' and kind in ('purchase', 'error') group by target")
def long_task_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each task's checks that are satisfied."""
    rows = V.of(ops(spark, sf_dir), "long_task_event").where(V.arg("kind").isin("purchase", "error"))
    good = F.count_if(V.arg("kind") == "purchase")
    return rows.groupBy("target").agg(good.alias("satisfied"), F.count("*").alias("checks"), F.round(good / F.count("*"), 6).alias("share"))


@query(f"select target, op_id, round(spent, 4) spent from (select target, op_id, sum(coalesce(amount, 0)) over (partition by target order by {_NEW} rows unbounded preceding) spent from {_OPS} where {_in(*_LONG)}) where round(spent, 4) <= 150")
def long_task_snapshot(spark: SparkSession, sf_dir: str, budget: float = 150.0) -> DataFrame:
    """The newest operations on each task that fit a budget."""
    return V.snapshot(ops(spark, sf_dir), budget)


@query(f"select target, tool state, op_id from {_last('register_task', 'update_task', *_LONG)}")
def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest operation on every task."""
    return latest(V.of(ops(spark, sf_dir), "register_task", "update_task", *_LONG)).select("target", F.col("tool").alias("state"), "op_id")


@query(f"select target, op_id, actor, place from (select *, row_number() over (partition by target order by {_NEW}) place from {_OPS} where {_in('msg_send', 'msg_respond')}) where place <= 20")
def msg_history(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The newest messages of every mailbox."""
    return V.newest(V.of(ops(spark, sf_dir), "msg_send", "msg_respond"), k, "target").select("target", "op_id", "actor", F.col("place").cast("long").alias("place"))


@query(f"with n as (select actor, kind, us, first_value(kind) over w f, row_number() over w i from {_OPS} where tool = 'narrative_log' window w as (partition by actor order by {_NEW})), s as (select *, min(case when kind <> f then i end) over (partition by actor) stop from n) select actor, f as mode, count(*) n, min(us) as \"first\" from s where stop is null or i < stop group by actor, f")
def narrative_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present stretch of every agent's work."""
    return V.segments(ops(spark, sf_dir))


@query(f"select op_id, target, actor from {_OPS} where tool = 'log_event' and kind = 'purchase' order by {_NEW} limit 100")
def get_relationship_events(spark: SparkSession, sf_dir: str, kind: str = "purchase", k: int = 100) -> DataFrame:
    """The newest events of a kind."""
    return V.newest(V.of(ops(spark, sf_dir), "log_event").where(V.arg("kind") == kind), k).select("op_id", "target", "actor")


@query(f"select op_id, tool, actor from {_OPS} where target = 'symbol:5' and {_in('log_event', 'log_event_ex')} order by {_NEW} limit 50")
def symbol_event_log(spark: SparkSession, sf_dir: str, symbol: str = "symbol:5", k: int = 50) -> DataFrame:
    """The newest events on a symbol."""
    return V.newest(V.of(ops(spark, sf_dir).where(F.col("target") == symbol), "log_event", "log_event_ex"), k).select("op_id", "tool", "actor")


@query(f"select target, max(kind) filter (us = last_us) as trigger, count(*) n from (select *, max(us) over (partition by target) last_us from {_OPS} where tool = 'learn_correction' and exists (select 1 from conversations where contains(lower(text), left(kind, 3)))) group by target")
def correction_check(spark: SparkSession, sf_dir: str, letters: int = 3) -> DataFrame:
    """Corrections whose trigger (the beginning of their kind) occurs in a turn, by target, with the latest one's."""
    rows = V.of(ops(spark, sf_dir), "learn_correction").withColumn("trigger", V.arg("kind"))
    # As many triggers as there are kinds: a row each, compared with every turn in one pass.
    kinds = rows.select("trigger").distinct()
    said = turns(spark, sf_dir).select(F.lower("text").alias("text")).join(F.broadcast(kinds), F.expr(f"contains(text, left(trigger, {letters}))")).select("trigger").distinct()
    hit = rows.join(F.broadcast(said), "trigger")
    return hit.groupBy("target").agg(F.max_by("trigger", F.struct("ts", "op_id")).alias("trigger"), F.count("*").alias("n"))


@query(f"select target from {_last('curiosity_note_gap', 'curiosity_resolve')} where tool = 'curiosity_note_gap' union select target from {_OPS} where tool = 'research_store'")
def research_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that are open, and what research was stored on."""
    o = ops(spark, sf_dir)
    return standing(o, "curiosity_note_gap", "curiosity_resolve").select("target").unionByName(V.of(o, "research_store").select("target")).distinct()


@query(f"select target gap, us since from {_last('curiosity_note_gap', 'curiosity_resolve')} where tool = 'curiosity_note_gap'")
def curiosity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that were noted and not resolved since."""
    return standing(ops(spark, sf_dir), "curiosity_note_gap", "curiosity_resolve").select(F.col("target").alias("gap"), V.us().alias("since"))


@query(f"with v as (select distinct target, us // 86400000000 as day from {_OPS} where tool = 'log_exposure'), g as (select distinct target, us // 86400000000 as day from {_OPS} where tool = 'memory_outcome' and kind = 'purchase') select v.day, count(*) exposures, count(g.day) useful, round(count(g.day) / count(*)::double, 6) ratio from v left join g on g.target = v.target and g.day = v.day group by v.day")
def get_sus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a day's shown memories that had a good outcome that day."""
    return V.useful(ops(spark, sf_dir)).withColumn("ratio", F.round(F.col("useful") / F.col("exposures"), 6))


@query(f"select op_id, target taken, 'symbol:' || (ref::bigint % {TARGETS} + 1) % {TARGETS} rejected from {_OPS} where tool = 'log_decision' and 'symbol:' || (ref::bigint % {TARGETS} + 1) % {TARGETS} <> target")
def recall_true_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with what was considered (the next symbol) and not taken."""
    rows = V.of(ops(spark, sf_dir), "log_decision")
    other = F.concat(F.lit("symbol:"), ((V.arg("ref").cast("long") % TARGETS + 1) % TARGETS).cast("string"))
    return rows.select("op_id", F.col("target").alias("taken"), other.alias("rejected")).where("taken <> rejected")
