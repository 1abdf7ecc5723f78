"""Motifs, lineage, likeness, binding, resampling, retry loops, lanes and jobs against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import binding, lineage, motifs, resample, saddles, similar
from recollect.streaming import lanes


def motif_states(tapes, depth, rate):
    """States by listing every n-gram of every tape."""
    ends, symbols = {}, {}
    for s, tape in sorted(tapes.items()):
        for i in range(len(tape)):
            for n in range(1, min(depth, i + 1) + 1):
                gram = tuple(x for x, _ in tape[i - n + 1 : i + 1])
                ends.setdefault(gram, []).append((s, i))
    found = {}
    for gram, places in ends.items():
        if len(places) < 2 or any(len(ends.get((x, *gram), [])) == len(places) for x in "abc"):
            continue
        q = 0.0
        for s, i in places:
            q += rate / len(places) * (tapes[s][i][1] - q)
        after = Counter(tapes[s][i + 1][0] for s, i in places if i + 1 < len(tapes[s]))
        best = min(after, key=lambda x: (-after[x], x)) if after else None
        found[">".join(gram)] = (len(gram), len(places), round(q, 6), best, after.get(best))
    return found


@pytest.mark.parametrize("depth", [1, 3, 12])
def test_motif_states_are_those_of_all_grams(spark, depth):
    rng = random.Random(depth)
    tapes = {s: [(rng.choice("aabc"), rng.choice([1.0, -1.0])) for _ in range(rng.choice([0, 1, 5, 60]))] for s in range(8)}
    tapes[9] = [("a", 1.0), ("b", -1.0), ("c", 1.0)] * 8
    rows = [(s, i + 1, x, r) for s, t in tapes.items() for i, (x, r) in enumerate(t)]
    tape = spark.createDataFrame(rows, "session long, place long, symbol string, reward double")
    found = {r.context: (r.n, r.size, r.q, r.after, r.support) for r in motifs.states(motifs.occurrences(tape, depth), 0.5).collect()}
    want = motif_states(tapes, depth, 0.5)
    assert found.keys() == want.keys()
    assert all(found[k][:2] == want[k][:2] and abs(found[k][2] - want[k][2]) < 2e-6 and found[k][3:] == want[k][3:] for k in want)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "older long, newer long")


def test_chains_of_any_length_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(130)] + [(200, 201), (201, 202), (202, 200), (300, 200)]
    start = spark.createDataFrame([(0,), (200,), (300,), (999,)], "id long")
    found = {}
    for r in lineage.chain(links(spark, pairs), start).collect():
        found.setdefault(r.start, []).append((r.position, r.id))
    assert [x for _, x in sorted(found[0])] == list(range(131))
    assert [x for _, x in sorted(found[200])] == [200, 201, 202] and [x for _, x in sorted(found[300])] == [300, 200, 201, 202] and found[999] == [(0, 999)]
    heads = {r.id: (r.head, r.steps) for r in lineage.heads(links(spark, pairs)).collect()}
    assert all(heads[i] == (130, 130 - i) for i in range(130)) and all(heads[i] == (None, None) for i in (200, 201, 202, 300))
    assert lineage.heads(links(spark, [])).count() == 0


def test_tables_of_places_are_not_broadcast(spark):
    tape = spark.createDataFrame([("s", i + 1, "ab"[i % 2], 1.0) for i in range(9)], "session string, place long, symbol string, reward double")
    plan = motifs.states(motifs.occurrences(tape, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_a_long_chain_takes_few_rounds(spark):
    rows = spark.range(12_000).select(F.col("id").alias("older"), (F.col("id") + 1).alias("newer"))
    found = lineage.chain(rows, spark.createDataFrame([(5,), (11_990,)], "id long"))
    told = found.groupBy("start").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.sum((F.col("id") - F.col("start") - F.col("position")).cast("long")).alias("off")).collect()
    assert sorted((r.start, r.n, r["last"], r.off) for r in told) == [(5, 11_996, 11_995, 0), (11_990, 11, 10, 0)]


def test_a_chain_that_parts_is_followed_to_each(spark):
    found = lineage.chain(links(spark, [(1, 2), (1, 3), (3, 4), (4, 1)]), spark.createDataFrame([(1,)], "id long")).collect()
    assert sorted((r.position, r.id) for r in found) == [(0, 1), (1, 2), (1, 3), (2, 4)]


def test_ancestors_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e"), ("d", "e")], "subject string, object string")
    found = {(r.node, r.ancestor): r.depth for r in lineage.ancestors(edges).collect()}
    assert found == {("a", "b"): 1, ("a", "e"): 1, ("a", "c"): 2, ("a", "a"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "b"): 3, ("b", "e"): 3, ("c", "a"): 1, ("c", "b"): 2, ("c", "e"): 2, ("c", "c"): 3, ("d", "a"): 1, ("d", "e"): 1, ("d", "b"): 2, ("d", "c"): 3}


def test_the_share_of_near_pairs_that_the_index_finds(spark):
    rng = np.random.default_rng(5)
    for dims in (2, 8, 64):
        base = rng.standard_normal((300, dims))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        away = rng.standard_normal((300, dims))
        away -= (away * base).sum(axis=1, keepdims=True) * base
        away /= np.linalg.norm(away, axis=1, keepdims=True)
        vectors = np.concatenate([base, 0.9001 * base + np.sqrt(1 - 0.9001**2) * away])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        found = {(r.a, r.b) for r in similar.near_pairs(df, 0.9).collect()}
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)), strict=True)}
        assert found <= want | {p for p in found if abs(unit[p[0]] @ unit[p[1]] - 0.9) < 1e-9} and len(found & want) >= 0.95 * len(want), (dims, len(found & want), len(want))


def test_odd_vectors_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in similar.near_pairs(df, 0.9).collect()] == [(1, 2, 1.0)] and similar.near_pairs(df.limit(0), 0.9).count() == 0


def test_consolidation_is_greedy_over_all_pairs(spark):
    rng = random.Random(2)
    pairs = {(a, b): rng.choice([0.9, 0.91, 0.95, 0.99]) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(220))}
    used, want = set(), []
    for (a, b), s in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, score double")
    found = similar.consolidate(df).collect()
    assert sorted((r.a, r.b, r.score) for r in found) == sorted(want) and max(r.round for r in found) > 1
    assert similar.consolidate(df.limit(0)).count() == 0


def test_a_filler_is_recalled_by_what_it_was_bound_with(spark):
    rng = random.Random(1)
    pairs = [(f"tool{i}", f"entity{i}") for i in range(20)] * 12 + [(f"tool{rng.randrange(20)}", f"entity{rng.randrange(20)}") for _ in range(40)] + [(None, "entity1"), ("tool1", None)]
    df = spark.createDataFrame(pairs, "tool string, entity string").repartition(3)
    for i in (0, 7, 19):
        found = binding.recall(df, "tool", f"tool{i}", "entity").orderBy("distance").collect()
        assert found[0].filler == f"entity{i}" and found[0].distance < 0.47 < found[1].distance and found[0].support >= 12
    # The bundle is the majority of every bit, whatever the partitions.
    ones = {r.bit: (r.ones, r.n) for r in binding.bundle(df, "tool", "entity", 256).collect()}
    want = sum((binding.bound("tool", x, 256) ^ binding.bound("entity", y, 256)).astype(int) for x, y in pairs if x and y)
    assert [ones[i] for i in range(256)] == [(w, 280) for w in want.tolist()]
    assert binding.recall(df.limit(0), "tool", "tool1", "entity").count() == 0


def test_bootstrap_intervals_are_those_of_resampling(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.gamma(2.0, 3.0, 900), "b": rng.standard_normal(400) + 10, "c": np.array([5.0])}
    rows = [(g, i, float(v)) for g, xs in x.items() for i, v in enumerate(xs)] + [("a", -1, None), ("d", 0, None)]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    found = {r.g: r for r in resample.intervals(df, "g", "id", "x").collect()}
    again = {r.g: r for r in resample.intervals(df.repartition(5), "g", "id", "x").collect()}
    assert set(found) == {"a", "b", "c"} and all(abs(found[g].lo - again[g].lo) < 1e-9 and abs(found[g].hi - again[g].hi) < 1e-9 for g in found)
    for g in "ab":
        means = np.sort([rng.choice(x[g], len(x[g])).mean() for _ in range(4000)])
        lo, hi = means[100], means[3899]
        assert found[g].n == len(x[g]) and abs(found[g].mean - x[g].mean()) < 1e-9 and abs(found[g].lo - lo) < 0.01 * abs(lo) and abs(found[g].hi - hi) < 0.01 * abs(hi)
    assert found["c"].lo == found["c"].hi == 5.0
    drawn = resample.weights(np.arange(3000, dtype=np.uint64), 200)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02


B = "session string, seq long, command string, exit_code int, likely_fail boolean, injected long"


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([("make x1", 1), ("make x2", 2), ("make x3", -9)], [(1, 3, 3, False, 0)]),
        ([("make x", 1), ("ls", 0), ("make x", 1), ("MAKE  x", 1), ("make x", 0), ("make x", 1)], [(1, 5, 3, True, 0)]),
        ([("make parser", 1), ("make parsers", 1), ("make parsed", 1), ("docker ps", 1)], [(1, 3, 3, False, 0)]),
        ([("make x", 1), ("make x", None), ("make x", 1)], []),
        ([("make x", 1)] + [("ls", 0)] * 8 + [("make x", 1), ("make x", 1)], []),
        ([("make x", 1), 7, ("make x", 1), 8, ("make x", 1), 9], [(1, 5, 3, False, 2)]),
        ([("a", 1)] * 12, [(1, 9, 9, False, 0), (10, 12, 3, False, 0)]),
        ([("", 1), ("", 1), (" ", 1)], [(1, 3, 3, False, 0)]),
        ([], []),
    ],
)
def test_retry_loops(spark, events, want):
    rows = [("s", i, None, None, None, e) if isinstance(e, int) else ("s", i, *e, None, None) for i, e in enumerate(events, 1)]
    found = saddles.saddles(spark.createDataFrame(rows, B)).collect()
    assert [tuple(r)[1:] for r in found] == want


def test_retries_that_likely_failed_and_heads(spark):
    rows = [("s", i, "make x", None, i < 4, None) for i in range(1, 6)]
    assert [tuple(r) for r in saddles.saddles(spark.createDataFrame(rows, B)).collect()] == [("s", 1, 5, 3, False, 0)]
    commands = ["  Make 12  x34\t5 ", "a" * 100, "", "x  y"]
    df = spark.createDataFrame([(c,) for c in commands], "c string")
    assert [r[0] for r in df.select(saddles.head(F.col("c"))).collect()] == [saddles.plain_head(c) for c in commands]


def test_urgent_lanes_go_first_and_restarts_apply_nothing_twice(spark, tmp_path):
    def put(lane, ids):
        spark.createDataFrame([(i, None if i < 0 else "x") for i in ids], "id long, body string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{lane}")

    def drain():
        streams = {n: spark.readStream.schema("id long, body string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n in ("fast", "slow")}
        found = lanes.drain_lanes(streams, f"{tmp_path}/q", "body is not null")
        return {n: sorted((r.id, r.turn) for r in spark.read.parquet(p).collect()) for n, p in found.items()}

    put("slow", [1, 2])
    put("slow", [3, -4])
    put("fast", [10])
    first = drain()
    assert {n: [i for i, _ in x] for n, x in first.items()} == {"fast": [10], "slow": [1, 2, 3]}
    assert max(t for _, t in first["fast"]) < min(t for _, t in first["slow"])
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/q/slow/dead").collect()] == [-4]
    put("fast", [11])
    put("slow", [5])
    again = drain()
    assert {n: [i for i, _ in x] for n, x in again.items()} == {"fast": [10, 11], "slow": [1, 2, 3, 5]}


def test_a_job_that_ran_is_not_run_again(spark, tmp_path):
    ran = []
    job = lambda name, seconds: lanes.Job(name, seconds, lambda since, until: ran.append((name, since, until)))
    jobs, second = [job("short", 10), job("long", 100)], 1_000_000
    assert lanes.Jobs(spark, str(tmp_path)).run(jobs, 50 * second) == ["short", "long"]
    assert lanes.Jobs(spark, str(tmp_path)).run(jobs, 50 * second) == []  # another driver, the same marks
    assert lanes.Jobs(spark, str(tmp_path)).run(jobs, 60 * second) == ["short"]
    assert lanes.Jobs(spark, str(tmp_path)).run(jobs, 150 * second) == ["short", "long"]
    assert ran == [("short", 0, 50 * second), ("long", 0, 50 * second), ("short", 50 * second, 60 * second), ("short", 60 * second, 150 * second), ("long", 50 * second, 150 * second)]

    def broken(since, until):
        raise ValueError("not now")

    with pytest.raises(ValueError):
        lanes.Jobs(spark, str(tmp_path)).run([lanes.Job("bad", 1, broken)], 200 * second)
    assert "bad" not in lanes.Jobs(spark, str(tmp_path)).marks()
