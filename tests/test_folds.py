"""Streaming folds against folding a table, with late arrivals and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.streaming import folds

T0 = 1_704_067_200_000_000


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, fold, schema, delay="0 seconds"):
    events = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    return sorted(tuple(r) for r in folds.drain(folds.folded(events, fold, "k", delay=delay), f"{tmp_path}/q").collect())


def rules(events, refute=0.4, reinstate=0.2):
    """Flips of rules, by going through each key's events."""
    told = []
    for k in sorted({e[0] for e in events}):
        own = sorted(e[1:] for e in events if e[0] == k)
        for x in "abc":
            for y in "abc":
                good = bad = 0
                refuted = False
                for (_, _, before), (us, seq, now) in zip(own, own[1:]):
                    if before != x or (not good and now != y):
                        continue
                    good, bad = good + (now == y), bad + (now != y)
                    share = bad / (good + bad)
                    new = True if share > refute else False if share < reinstate else refuted
                    if new != refuted:
                        told.append((k, x, y, us, seq, new, good, bad))
                    refuted = new
    return sorted(told)


def test_rules_are_refuted_and_reinstated_whatever_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(3)
    events = [(k, T0 + 1_000_000 * i, i, rng.choices("abc", [1, 1, 1] if i < 30 else [20, 1, 1])[0]) for k in (1, 2, 3) for i in range(160)]
    schema = "k long, us long, seq long, symbol string"
    cut = T0 + 60_000_000
    first = [e for e in events if e[1] < cut]
    rng.shuffle(first)
    write(spark, f"{tmp_path}/in", first, schema)
    early = run(spark, tmp_path, folds.Refutation(), schema, "30 seconds")
    assert early == [r for r in rules(events) if r[3] <= cut - 1_000_000 - 30_000_000]  # what the watermark has passed
    # Late ones within the delay take their place; the restart goes on from the checkpoint.
    write(spark, f"{tmp_path}/in", [e for e in events if e[1] >= cut], schema)
    later = run(spark, tmp_path, folds.Refutation(), schema, "30 seconds")
    assert later == [r for r in rules(events) if r[3] <= T0 + 159_000_000 - 30_000_000] and len(later) > len(early) > 0
    table = spark.createDataFrame(events, schema)
    assert sorted(tuple(r) for r in folds.folded_batch(table, folds.Refutation(), "k").collect()) == rules(events)
    assert {r[5] for r in rules(events)} == {True, False}


def test_late_events_within_the_delay_are_folded_in_their_order(spark, tmp_path):
    schema = "k long, us long, seq long, good boolean, weight double"
    write(spark, f"{tmp_path}/in", [(1, T0 + 30_000_000, 2, True, 2.0)], schema)
    assert run(spark, tmp_path, folds.Posterior(), schema, "20 seconds") == []
    write(spark, f"{tmp_path}/in", [(1, T0 + 15_000_000, 1, False, 1.0), (1, T0 + 90_000_000, 3, True, 1.0)], schema)
    assert run(spark, tmp_path, folds.Posterior(), schema, "20 seconds") == [(1, T0 + 15_000_000, 1, 2.0, 3.0), (1, T0 + 30_000_000, 2, 4.0, 3.0)]
    assert run(spark, tmp_path, folds.Posterior(), schema, "20 seconds")[-1] == (1, T0 + 30_000_000, 2, 4.0, 3.0)  # nothing is told twice


def test_leases_expire_by_timer_and_by_the_next_heartbeat(spark, tmp_path):
    at = lambda s: T0 + s * 1_000_000
    schema = "k long, us long, seq long"
    write(spark, f"{tmp_path}/in", [(1, at(0), 0), (1, at(50), 1), (1, at(200), 2), (2, at(10), 3), (3, at(400), 4)], schema)
    told = run(spark, tmp_path, folds.Lease(100), schema)
    assert told == [(1, 1, at(0), at(50), at(150)), (1, 2, at(200), at(200), at(300)), (2, 1, at(10), at(10), at(110))]
    write(spark, f"{tmp_path}/in", [(2, at(450), 5), (4, at(900), 6)], schema)
    assert run(spark, tmp_path, folds.Lease(100), schema) == sorted([*told, (2, 2, at(450), at(450), at(550)), (3, 1, at(400), at(400), at(500))])
    table = spark.createDataFrame([(1, at(0), 0), (1, at(50), 1), (1, at(200), 2), (2, at(10), 3)], schema)
    assert sorted(tuple(r) for r in folds.folded_batch(table, folds.Lease(100), "k", at(400)).collect()) == told


@pytest.mark.parametrize("schema", [folds.Refutation.state, folds.Posterior.event, folds.Lease.output])
def test_names_of_schemas(spark, schema):
    assert folds._names(schema) == spark.createDataFrame([], schema).columns
