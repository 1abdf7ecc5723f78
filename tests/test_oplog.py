"""The append-only log: latest wins, as of a time, once after a restart."""

import datetime as dt

import pytest

from recollect.operators import oplog


def row(op_id, tool, target, minute, **args):
    return (op_id, tool, target, "a", {k: str(v) for k, v in args.items()}, dt.datetime(2024, 1, 1, 0, minute))


def test_latest_wins_and_earlier_states_can_be_read(spark, tmp_path):
    folder = f"file://{tmp_path}/ops"
    first = [row("1", "pin_memory", "m1", 0), row("2", "pin_memory", "m2", 1), row("3", "strengthen", "m1", 2, amount=0.2)]
    oplog.append(spark, folder, first)
    oplog.append(spark, folder, [*first[1:], row("4", "unpin_memory", "m1", 3), row("5", "weaken", "m1", 4, amount=0.5), row("6", "goal_set", "g", 5)])
    ops = oplog.read(spark, folder, "memory")
    assert ops.count() == 5
    assert [r.target for r in oplog.standing(ops, "pin_memory", "unpin_memory").collect()] == ["m2"]
    before = oplog.read(spark, folder, "memory", as_of="2024-01-01 00:02:30")
    assert sorted(r.target for r in oplog.standing(before, "pin_memory", "unpin_memory").collect()) == ["m1", "m2"]
    assert [(r.target, round(r.amount, 6)) for r in oplog.amounts(ops, {"strengthen": 1.0, "weaken": -1.0}, 0.5).collect()] == [("m1", 0.2)]
    assert {r.target: r.op_id for r in oplog.latest(oplog.read(spark, folder)).collect()} == {"m1": "5", "m2": "2", "g": "6"}
    assert "PartitionFilters: [isnotnull(family" in ops._jdf.queryExecution().toString()


def test_unknown_writes_are_refused(spark, tmp_path):
    assert len(oplog.FAMILY) == 164
    with pytest.raises(Exception, match="no such write"):
        oplog.append(spark, f"file://{tmp_path}/ops", [row("1", "no_such_tool", "m", 0)])
