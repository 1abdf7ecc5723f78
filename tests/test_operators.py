from collections import Counter, deque

from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import fusion, graph, lexical, tape, vector
from recollect.plans import graphs


def test_lex_tokens_of_columns_and_of_queries_agree(spark):
    texts = ["The dark_mode-switch is ON", "", "a-b cc_ddd", "what how why"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [sorted(r[0]) for r in df.select(T.lex_tokens("t")).collect()] == [T.python_lex_tokens(t) for t in texts]


def test_speech_act_takes_the_first_that_matches(spark):
    df = spark.createDataFrame([("We decided; it failed",), ("it failed",), ("hello",)], "t string")
    assert [r[0] for r in df.select(T.speech_act(F.col("t"))).collect()] == ["decision", "failure", None]


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "memory_id long, content string")
    assert lexical.bm25(lexical.index(docs), "?!").count() == 0
    assert lexical.bm25(lexical.index(docs), "zzz").count() == 0
    assert [r.memory_id for r in lexical.bm25(lexical.index(docs), "B").collect()] == [1]


def test_cosine_of_odd_vectors_is_zero(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], []), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine("a", "b")).collect()] == [0.0, 0.0, 0.0, 1.0]


def test_quantised_values_come_back_within_a_step(spark):
    r = spark.createDataFrame([([0.1, -0.5, 0.9],)], "v array<double>").select(vector.quantised("v").alias("q")).first().q
    assert all(abs(c * r.scale + r.offset - x) <= r.scale for c, x in zip(r.codes, [0.1, -0.5, 0.9], strict=True))


def test_rrf_prefers_what_both_lanes_have(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "memory_id long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "memory_id long, rank long")
    assert fusion.rrf({"a": a, "b": b}).orderBy(F.desc("score")).first().memory_id == 2


def test_bfs_against_a_queue(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "a"), ("c", "e")]
    df = spark.createDataFrame([(s, "to", o, 1.0) for s, o in edges], "subject string, predicate string, object string, weight double")
    seen, todo = {"a": 0}, deque(["a"])
    while todo:
        n = todo.popleft()
        for s, o in edges:
            if s == n and o not in seen and seen[n] < 2:
                seen[o] = seen[n] + 1
                todo.append(o)
    assert {r.node: r.hop for r in graph.bfs(df, "a", hops=2, direction="outgoing").collect()} == seen
    assert [r.node for r in graph.bfs(df, "nowhere").collect()] == ["nowhere"]


def test_label_propagation_splits_two_cliques(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    df = spark.createDataFrame([(s, "calls", o, 1.0) for s, o in edges], "subject string, predicate string, object string, weight double")
    found = {r.node: r.label for r in graph.label_propagation(df).collect()}
    assert len({found[n] for n in "abc"}) == 1 and len({found[n] for n in "xyz"}) == 1 and found["a"] != found["x"]


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 0), (10, 10), (5, 10)], "s long, n long")
    zero, high, mid = [r[0] for r in df.select(tape.wilson(F.col("s"), F.col("n"))).collect()]
    assert zero == 0 and 0.7 < high < 0.73 and 0.23 < mid < 0.24


def test_outcomes_against_all_pairs(spark):
    shown = [(0, 1, 7, "2024-01-01 00:00:00"), (1, 1, 8, "2024-01-01 00:00:50"), (2, 2, 7, "2024-01-01 00:00:00"), (3, 3, 9, "2024-01-01 00:00:00"), (4, 4, 9, "2024-01-01 00:00:00"), (5, 5, 9, "2024-01-01 00:00:00")]
    done = [(1, "2024-01-01 00:01:00", 0, False), (1, "2024-01-01 00:01:01", 1, False), (2, "2024-01-01 00:00:00", 1, False), (3, "2024-01-01 00:00:05", -9, False), (3, "2024-01-01 00:00:06", 0, False), (4, "2024-01-01 00:00:05", 0, None), (5, "2024-01-01 00:00:05", None, None)]
    a = spark.createDataFrame(shown, "event_id long, session long, item long, ts string").withColumn("ts", F.to_timestamp("ts"))
    b = spark.createDataFrame(done, "session long, ts string, exit_code int, flagged boolean").withColumn("ts", F.to_timestamp("ts"))
    want = {}
    for e, s, item, t in shown:
        hits = [(c, f) for s1, t1, c, f in done if s1 == s and 0 <= int(t1[-2:]) + 60 * int(t1[-5:-3]) - int(t[-2:]) - 60 * int(t[-5:-3]) <= 60]
        bad, known = any(c not in (None, 0) or f for c, f in hits), any(c is not None for c, _ in hits)
        n, good, fails = want.get(item, (0, 0, 0))
        want[item] = (n + 1, good + (known and not bad), fails + bad)
    assert {r["item"]: (r.injections, r.successes, r.failures) for r in tape.outcomes(a, b, 60).collect()} == want == {7: (2, 1, 1), 8: (1, 0, 1), 9: (3, 1, 1)}


def test_cooccurrence_deals_lines_to_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    lines = [(o, p) for o in range(60) for p in range(o % 7, o % 7 + 3)] + [(0, 0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(graphs, "LINES_OF_A_TASK", 10)
    found = graphs.cooccurrence(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 19), REPARTITION_BY_NUM") >= 3  # 181 lines
    counts = Counter((a, b) for o in range(60) for a in range(o % 7, o % 7 + 3) for b in range(a + 1, o % 7 + 3))
    assert {(r.part, r.other): r.n for r in found.collect()} == {k: n for k, n in counts.items() if n >= 2}
