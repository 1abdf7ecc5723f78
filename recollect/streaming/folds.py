"""Stateful folds over event streams: rules that are refuted and reinstated, posteriors, leases that expire.

A fold sees the events of its key in their order, however they arrive: they wait in the key's state until the watermark has
passed them, then they are folded. Timers wake a key when its next event is due and when its lease runs out. State
lies in RocksDB under the query's checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What a fold does with an event; state is a tuple of plain values, None at first."""

    state: str  #: schema of the state
    event: str  #: schema of an event; begins with us long (microseconds) and seq long
    output: str  #: schema of what is told, without the key

    def step(self, state: tuple | None, event: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple | None) -> int | None:
        """When (microseconds) the state changes if nothing happens, if ever."""
        return None

    def expire(self, state: tuple, now: int) -> tuple[tuple | None, list[tuple]]:
        """What happens then."""
        return state, []


class Refutation(Fold):
    """Rules x -> y of a key: refuted when more than so large a share of what follows x isn't y, reinstated below another.

    A rule exists from the first time y follows x. Between the two shares it stays what it was. Told: every change.
    """

    state = "last string, rules array<struct<x:string,y:string,good:long,bad:long,refuted:boolean>>"
    event = "us long, seq long, symbol string"
    output = "antecedent string, consequent string, us long, seq long, refuted boolean, support long, contradict long"

    def __init__(self, refute: float = 0.4, reinstate: float = 0.2):
        self.refute, self.reinstate = refute, reinstate

    def step(self, state, event):
        last, rules = state or (None, [])
        us, seq, symbol = event
        told, known = [], {(r[0], r[1]): list(r[2:]) for r in rules}
        if last is not None:
            known.setdefault((last, symbol), [0, 0, False])
            for (x, y), rule in known.items():
                if x != last:
                    continue
                rule[0 if y == symbol else 1] += 1
                share = rule[1] / (rule[0] + rule[1])
                refuted = share > self.refute or (rule[2] and share >= self.reinstate)
                if refuted != rule[2]:
                    rule[2] = refuted
                    told.append((x, y, us, seq, refuted, rule[0], rule[1]))
        return (symbol, [(x, y, *r) for (x, y), r in known.items()]), told


class Posterior(Fold):
    """Beta posterior of success from a prior; told after every event."""

    state = "alpha double, beta double"
    event = "us long, seq long, good boolean, weight double"
    output = "us long, seq long, alpha double, beta double"

    def __init__(self, alpha: float = 2.0, beta: float = 2.0):
        self.prior = (alpha, beta)

    def step(self, state, event):
        us, seq, good, weight = event
        alpha, beta = state or self.prior
        alpha, beta = (alpha + weight, beta) if good else (alpha, beta + weight)
        return (alpha, beta), [(us, seq, alpha, beta)]


class Lease(Fold):
    """Leases that heartbeats renew: one ends so long after its last heartbeat, the next has a higher generation. Told: those that ended."""

    state = "generation long, acquired long, last long, live boolean"
    event = "us long, seq long"
    output = "generation long, acquired long, last long, expired long"

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def step(self, state, event):
        us, _ = event
        told = []
        if state and state[3] and us >= state[2] + self.micros:
            state, told = self.expire(state, us)
        if state and state[3]:
            return (state[0], state[1], us, True), told
        return ((state[0] if state else 0) + 1, us, us, True), told

    def due(self, state):
        return state[2] + self.micros if state and state[3] else None

    def expire(self, state, now):
        generation, acquired, last, _ = state
        return (generation, acquired, last, False), [(generation, acquired, last, last + self.micros)]


def _names(schema: str) -> list[str]:
    """Top-level names of a schema of the kind above."""
    names, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += c == "<"
        depth -= c == ">"
        if c == "," and not depth:
            names.append(schema[start:i].split()[0])
            start = i + 1
    return names


def _plain(value: Any) -> Any:
    """A value of a state without the Row class, which can't be written back."""
    if isinstance(value, tuple):
        return tuple(_plain(v) for v in value)
    return [_plain(v) for v in value] if isinstance(value, list) else value


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, key: str):
        self.fold, self.columns = fold, [key, *_names(fold.output)]

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.fold.event)
        self.held = handle.getValueState("state", self.fold.state)
        self.alarm = handle.getValueState("alarm", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = _names(self.fold.event)
        for part in rows:
            for event in part[names].itertuples(index=False):
                self.pending.appendValue(tuple(None if v is None or v != v else v for v in event))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        now = watermark * 1000
        events = sorted(_plain(e) for e in self.pending.get())
        state = _plain(self.held.get()) if self.held.exists() else None
        told: list[tuple] = []
        done = 0
        while done < len(events) and events[done][0] // 1000 <= watermark:
            state, more = self.fold.step(state, events[done])
            told += more
            done += 1
        due = self.fold.due(state)
        if due is not None and due <= now and (done == len(events) or due <= events[done][0]):
            state, more = self.fold.expire(state, now)
            told, due = told + more, None
        if done:
            self.pending.put(events[done:]) if done < len(events) else self.pending.clear()
        if state is not None:
            self.held.update(state)
        # One alarm at a time: the next event that waits, or what is due.
        times = [t for t in (events[done][0] // 1000 if done < len(events) else None, None if due is None else -(-due // 1000)) if t is not None]
        next_ = min(times, default=None)
        old = self.alarm.get()[0] if self.alarm.exists() else None
        if next_ != old:
            if old is not None:
                self.handle.deleteTimer(old)
                self.alarm.clear()
            if next_ is not None:
                self.handle.registerTimer(next_)
                self.alarm.update((next_,))
        if told:
            yield pd.DataFrame([(key[0], *t) for t in told], columns=self.columns)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, fold: Fold, key: str, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """key and the output of a fold over a stream that has the key, the event's columns and a timestamp; late events are dropped after the delay."""
    kind = dict(stream.dtypes)[key]
    events = stream.withWatermark(ts, delay)
    return events.groupBy(key).transformWithStateInPandas(_Processor(fold, key), f"{key} {kind}, {fold.output}", "Append", "EventTime")


def folded_batch(events: DataFrame, fold: Fold, key: str, until: int | None = None) -> DataFrame:
    """The same over a table: what folded() tells once its watermark (microseconds) has reached until, or the end."""
    kind, names = dict(events.dtypes)[key], _names(fold.event)
    columns = [key, *_names(fold.output)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own, state, told = rows[key].iloc[0], None, []
        for event in sorted(tuple(e) for e in rows[names].itertuples(index=False)):
            state, more = fold.step(state, event)
            told += more
        due = fold.due(state)
        if due is not None and until is not None and due <= until:
            told += fold.expire(state, until)[1]
        return pd.DataFrame([(own, *t) for t in told], columns=columns)

    return events.groupBy(key).applyInPandas(run, f"{key} {kind}, {fold.output}")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Fold what is there, append what is told to folder/told, and stop; the checkpoint in folder/checkpoint lets a restart go on."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/told")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/told")
