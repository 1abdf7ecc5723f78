"""Event-sequence, thread, compaction and recall operators on small cases."""

import datetime as dt
import math

import pandas as pd
import pytest

from recollect.operators import graph, tape, threads, transcript
from recollect.operators import recall as recalls
from recollect.sources.transcripts import read_transcripts

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def outcomes_of(spark, injected, events):
    left = spark.createDataFrame([(i, 1, item, at(m)) for i, (item, m) in enumerate(injected)], "event_id long, session long, item string, ts timestamp")
    right = spark.createDataFrame([(1, at(m), code, flag) for m, code, flag in events], "session long, ts timestamp, exit_code int, flagged boolean")
    return {r["item"]: (r.injections, r.successes, r.failures, r.score) for r in tape.outcomes(left, right, 3600).collect()}


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([(1, 0, False), (2, 0, False)], (1, 1, 0)),
        ([(1, 0, False), (2, 1, False)], (1, 0, 1)),
        ([], (1, 0, 0)),
        ([(1, None, False)], (1, 0, 0)),
        ([(1, None, True)], (1, 0, 1)),
        ([(1, 0, False), (2, None, True)], (1, 0, 1)),
        ([(61, 0, False)], (1, 0, 0)),
        ([(60, 0, False)], (1, 1, 0)),
    ],
)
def test_an_injection_gets_one_verdict(spark, events, want):
    injections, successes, failures, score = outcomes_of(spark, [("a", 0)], events)["a"]
    assert (injections, successes, failures) == want
    n, p, z = successes + failures, successes / max(1, successes + failures), 1.96
    bound = max(0.0, (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)) if n else 0.0
    assert score == pytest.approx(bound, abs=1e-6)


def test_retries_end_with_a_success_or_a_gap(spark):
    tools = ["error", "view", "error", "error", "purchase", "error"] + ["view"] * 9 + ["error", "error", "error"]
    entity = [1, 2, 1, 1, 1, 1] + [3] * 9 + [1, 1, 1]
    df = spark.createDataFrame([(i, 7, t, e, at(i)) for i, (t, e) in enumerate(zip(tools, entity, strict=True))], "event_id long, session long, tool string, entity int, ts timestamp")
    found = sorted((r.opened, r.fails, r.escaped) for r in tape.retries(df, 3, 8).collect())
    assert found == [(1, 3, True), (16, 3, False)]


def test_threads_alike(spark):
    rows = [(0, 0, "the parser fails on nested brackets"), (0, 1, "parser brackets"), (1, 0, "nested brackets parser fails"), (2, 0, "holiday plans")]
    prints = threads.fingerprints(spark.createDataFrame(rows, "session long, turn long, text string"))
    weights = {(r.session, r.term): r.weight for r in prints.collect()}
    assert weights[0, "parser"] == pytest.approx(2 / 6 * (math.log(3 / 3) + 1)) and (0, "the") not in weights
    found = {r.session: r.match for r in threads.match(prints, 0).collect()}
    assert found == {1: "strong"}


def test_compaction_keeps_the_last_turns_and_what_answers(spark):
    rows = [(1, i, "assistant", f"filler words number {i} " + "pad " * 10) for i in range(6)] + [(1, 6, "assistant", "apache license token"), (1, 7, "user", "which apache license")]
    kept = {r.turn for r in transcript.compact(spark.createDataFrame(rows, "session long, turn long, role string, text string"), 40).collect()}
    assert {6, 7} <= kept and len(kept) < 8


@pytest.mark.parametrize(
    ("costs", "scores", "good", "want"),
    [
        ([600, 3, 3, 3, 3], [9, 5, 4, 3, 2], [True, False, False, False, False], [1, 2, 3, 4]),  # a turn beyond the budget doesn't keep others out
        ([30, 20, 15, 5, 5], [9, 8, 7, 1, 2], [True, True, True, False, False], [0, 1, 3, 4]),  # the third good one is one too many
        ([50, 10, 30], [9, 1, 2], [True, False, False], [0, 1]),  # the last one fits no slack any more
        ([50, 1, 12], [9, 1, 2], [True, False, False], [0, 1, 2]),
        ([58, 5, 9], [9, 1, 2], [True, False, False], [0, 1, 2]),  # the last two may go a fifth beyond
        ([], [], [], []),
    ],
)
def test_what_stays_within_a_budget(costs, scores, good, want):
    rows = pd.DataFrame({"i": range(len(costs)), "cost": costs, "score": scores, "good": good})
    assert [i for i, s in zip(rows["i"], transcript._selected(rows, 60), strict=True) if s] == want


def test_shortest_connections(spark):
    edges = spark.createDataFrame([("a", "p", "b"), ("c", "p", "b"), ("c", "p", "d"), ("a", "p", "x"), ("x", "p", "y")], "subject string, predicate string, object string")
    assert sorted(tuple(r) for r in graph.shortest(edges, "a", "d").collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert graph.shortest(edges, "a", "nowhere").count() == 0


def test_recall_bridges_filters_and_drops(spark):
    rows = [
        (1, "en", "r", "license text one https://e.org/a", "active", 0, 10),
        (2, "en", "r", "[gap] license", "active", 0, 10),
        (3, "en", "r", "license superseded", "superseded", 0, 10),
        (4, "en", "r", "something else https://e.org/a", "active", 0, 99),
        (5, "en", "r", "license stale", "archived", 0, 10),
    ]
    memories = spark.createDataFrame(rows, "memory_id long, kind string, realm string, content string, status string, access int, created long")
    lane = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (5, 4)], "memory_id long, rank long")
    found = [r.memory_id for r in recalls.recall(recalls.Asked("license text"), memories, [(lane, 1.0)]).orderBy("rank").collect()]
    assert found[0] == 1 and set(found) == {1, 4, 5}  # 4 comes over the bridge of a shared address
    inside = recalls.recall(recalls.Asked("license text", window=(0, 50)), memories, [(lane, 1.0)]).collect()
    assert {r.memory_id for r in inside} == {1, 5}
    tagged = spark.createDataFrame([(4,)], "memory_id long")
    lane = spark.createDataFrame([(5, 1)], "memory_id long, rank long")
    only = recalls.recall(recalls.Asked("license text", tag="t"), memories, [(lane, 1.0)], tagged).collect()
    assert [r.memory_id for r in only] == [4]
    assert recalls.multi_lane("an entity question here") and not recalls.multi_lane("abc")


def test_recall_over_the_graph_and_with_separation(spark):
    texts = ["license alpha https://e.org/a", "middle https://e.org/a https://e.org/b", "far away https://e.org/b", "license other words", "license other words too", "nothing at all"]
    rows = [(i, "en", "r" if i != 6 else "s", t, "active", 0, 10) for i, t in enumerate(texts, 1)]
    memories = spark.createDataFrame(rows, "memory_id long, kind string, realm string, content string, status string, access int, created long")
    lane = spark.createDataFrame([(1, 1), (4, 2), (5, 3), (6, 4)], "memory_id long, rank long")
    sure = spark.createDataFrame([(5, 0.9), (1, 0.1)], "memory_id long, cosine double")

    def asked(**more):
        return [r.memory_id for r in recalls.recall(recalls.Asked("license question", **more), memories, [(lane, 1.0)], sure=sure).orderBy("rank").collect()]

    plain, reached = asked(), asked(graph=True)
    assert set(plain) == {1, 2, 4, 5, 6} and set(reached) == {1, 2, 3, 4, 5, 6} and reached[0] == 5  # what is sure stays ahead
    assert set(asked(realm="r")) == {1, 2, 4, 5}
    # Of two likenesses the second comes after what is different, if that isn't much worse.
    apart = asked(separate=True, limit=3)
    assert len(apart) == 3 and not {4, 5} <= set(apart[:2])
    assert asked(window=(0, 5)) == []


def test_lines_of_transcripts_are_numbered_over_splits(spark, tmp_path):
    lines = ["not json" if i % 50 == 0 else f'{{"type":"user","message":{{"role":"user","content":"turn {i} {"x" * 50}"}}}}' for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:3]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = read_transcripts(spark, str(tmp_path)).collect()
        assert {(r.path[-7:], r.line, r.text.split(" ")[1]) for r in found} == {("a.jsonl", i, str(i)) for i in range(400) if i % 50} | {("b.jsonl", i, str(i)) for i in (1, 2)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
