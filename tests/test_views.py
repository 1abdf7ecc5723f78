"""Views of the op-log over what the library's own log wrote."""

import datetime as dt

from pyspark.sql import functions as F

from recollect.operators import oplog
from recollect.operators import views as V


def log_of(spark, tmp_path, rows):
    folder = f"file://{tmp_path}/ops"
    oplog.append(spark, folder, [(str(i), tool, target, actor, {k: str(v) for k, v in args.items()}, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for i, (h, tool, target, actor, args) in enumerate(rows)])
    return oplog.read(spark, folder)


def test_locks_goals_debts_and_lineages(spark, tmp_path):
    o = log_of(spark, tmp_path, [
        (0, "memory_lock", "m1", "a", {"amount": 2}), (1, "memory_lock", "m2", "b", {"amount": 50}), (1, "memory_lock", "m3", "b", {}), (2, "memory_unlock", "m3", "b", {}),
        (0, "goal_progress", "g1", "a", {"amount": 90}), (1, "goal_set", "g1", "a", {}), (2, "goal_progress", "g1", "a", {"amount": 30}), (3, "goal_progress", "g1", "a", {"amount": "x"}), (1, "goal_set", "g2", "a", {}), (2, "goal_complete", "g2", "a", {}), (5, "goal_progress", "g3", "a", {"amount": 5}),
        (0, "register_debt", "d1", "a", {}), (1, "attach_debt_evidence", "d1", "a", {"amount": 30}), (2, "attach_debt_evidence", "d1", "a", {"amount": 50}), (0, "register_debt", "d2", "a", {}), (1, "resolve_debt", "d2", "a", {}),
        (0, "enroll_wisdom_lineage", "l1", "a", {}), (1, "transition_wisdom_lineage", "l1", "a", {"kind": "purchase"}), (2, "transition_wisdom_lineage", "l1", "a", {"kind": "error"}), (0, "enroll_wisdom_lineage", "l2", "a", {}),
    ])
    o = o.withColumn("args", F.when(F.try_element_at("args", F.lit("amount")) == "x", F.create_map(F.lit("amount"), F.lit("0"))).otherwise(F.col("args")))
    now = F.lit(int(dt.datetime(2024, 1, 1, 10, tzinfo=dt.UTC).timestamp()) * 1_000_000)
    assert {tuple(r) for r in V.locks(o, now).collect()} == {("m1", "a", "expired"), ("m2", "b", "held"), ("m3", "b", "released")}
    assert {tuple(r) for r in V.progress(o, 120).collect()} == {("g1", 0.25, "open"), ("g2", 0.0, "complete")}
    assert {tuple(r) for r in V.debts(o).collect()} == {("d1", "open", 0.4, 2), ("d2", "resolved", 0.0, 0)}
    assert {tuple(r)[:4] for r in V.lineages(o).collect()} == {("l1", "error", 1, 1), ("l2", "enrolled", 0, 0)}
    assert {r.target: r.state for r in V.states(o, {"memory_lock": "on", "memory_unlock": "off"}).collect()} == {"m1": "on", "m2": "on", "m3": "off"}
    assert {(r.target, r.n) for r in V.tally(o, {"attach_debt_evidence": "n"}).collect()} == {("d1", 2)}


def test_segments_snapshots_versions_and_days(spark, tmp_path):
    kinds = ["plan", "build", "build", "test", "test", "test"]
    o = log_of(spark, tmp_path, [
        *((h, "narrative_log", "x", "a", {"kind": k}) for h, k in enumerate(kinds)), (0, "narrative_log", "x", "b", {"kind": "plan"}),
        *((h, "long_task_event", "t", "a", {"amount": 10}) for h in range(5)),
        (0, "skill_upload", "s", "a", {}), (1, "skill_upload", "s", "a", {}),
        (0, "log_exposure", "m1", "a", {}), (1, "log_exposure", "m1", "a", {}), (30, "log_exposure", "m1", "a", {}), (2, "log_exposure", "m2", "a", {}), (5, "memory_outcome", "m1", "a", {"kind": "purchase"}), (6, "memory_outcome", "m2", "a", {"kind": "error"}),
    ])
    assert {tuple(r)[:3] for r in V.segments(o).collect()} == {("a", "test", 3), ("b", "plan", 1)}
    assert sorted(r.spent for r in V.snapshot(o, 35).collect()) == [10, 20, 30]
    assert sorted((r.version, r.versions) for r in V.versions(o, "skill_upload").collect()) == [(1, 2), (2, 2)]
    assert sorted((r.exposures, r.useful) for r in V.useful(o).collect()) == [(1, 0), (2, 1)]
    assert V.newest(o, 3).count() == 3 and V.newest(V.of(o, "log_exposure"), 1, "target").count() == 2
    assert V.segments(o.limit(0)).count() == 0 and V.useful(o.limit(0)).count() == 0
