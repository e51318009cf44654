"""State by key that Spark keeps: last-N buffers, expiring entries, circuit breakers, task machines, changed keys.

Each is a stateful processor for ``transformWithStateInPandas``. State lives in the RocksDB state store, by key, with the checkpoint; a
batch reads and writes only the keys that it holds or whose timers are due. Timers are in event time: an entry expires, and an open
breaker becomes half open, when an event of any key has passed that time, whether or not their own key gets events.

Event time has milliseconds here. Events that come later than ``LATE`` after the newest one of earlier batches are dropped by the
watermark, as everywhere in Structured Streaming. Null keys are a key like others; a null event time makes an entry that never expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from quern.operators.lifecycle import breaker_step
from quern.operators.memory import task_shown, task_start, task_step

#: How late an event may be, in milliseconds.
LATE = 1000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def due(at_ms: int) -> int:
    """The timer of what is due at ``at_ms``: it fires once the watermark, which stays LATE behind, shows that time as reached."""
    return max(1, at_ms - LATE)


def keyed(stream: DataFrame, by: list[str], processor: StatefulProcessor, schema: str, timers: bool = False) -> DataFrame:
    """``processor`` on each key of ``stream``. With ``timers`` the stream needs a timestamp column ts."""
    use_state_store(stream.sparkSession)
    if timers:
        stream = stream.withWatermark("ts", f"{LATE} milliseconds")
    return stream.groupBy(*by).transformWithStateInPandas(processor, schema, "Update", "EventTime" if timers else "None")


def _rows(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [r for part in rows for r in zip(*(part[c].tolist() for c in columns))]


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class LastN(_Processor):
    """The ``n`` rows with the greatest (order, id) of each key. Gives the key's whole buffer, with its version, when it changes."""

    def __init__(self, n: int, id_col: str, key: str):
        self.n, self.id_col, self.key = n, id_col, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "position bigint, id bigint")
        self.version = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.kept.get()]
        new = sorted(old + _rows(rows, ["position", "id"]), reverse=True)[: self.n]
        if new != old:
            version = self.version.get()[0] + 1 if self.version.exists() else 0
            self.kept.put(new)
            self.version.update((version,))
            yield pd.DataFrame({self.key: [key[0]] * len(new), self.id_col: [r[1] for r in new], "rn": range(1, len(new) + 1), "version": version})


def last_n(stream: DataFrame, by: str, order: str, id_col: str, n: int) -> DataFrame:
    """(by, id, rn, version): a key's buffer each time it changes; the highest version of a key is the current one."""
    types = dict(stream.dtypes)
    return keyed(stream.select(by, F.col(order).cast("long").alias("position"), F.col(id_col).cast("long").alias("id")), [by], LastN(n, id_col, by), f"{by} {types[by]}, {id_col} bigint, rn bigint, version bigint")


class Expiring(_Processor):
    """Entries (id, expiry) of a shard, as arrays of numbers: what a batch brings is one element of the state. One timer is set, for the
    entry that is due first; when it fires, all that are due go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "ids binary, expiries binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _set(self, at: int) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            ids, expiries = part["id"].to_numpy(np.int64), part["expiry"].to_numpy(np.int64)
            if len(ids):
                self.live.appendValue((ids.tobytes(), expiries.tobytes()))
                first = min(int(expiries.min()), first) if first is not None else int(expiries.min())
                yield pd.DataFrame({"id": ids, "expiry": expiries, "live": True})
        if first is not None:
            self._set(due(first))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() + LATE
        stay, first = [], None
        for a, b in self.live.get():
            ids, expiries = np.frombuffer(bytes(a), np.int64), np.frombuffer(bytes(b), np.int64)
            gone = expiries <= now
            if not gone.all():
                stay.append((ids[~gone].tobytes(), expiries[~gone].tobytes()))
                least = int(expiries[~gone].min())
                first = least if first is None else min(first, least)
            yield pd.DataFrame({"id": ids[gone], "expiry": expiries[gone], "live": False})
        self.timer.clear()
        if stay:
            self.live.put(stay)
            self._set(due(first))
        else:
            self.live.clear()


def expiring(stream: DataFrame, id_col: str, seconds: int, shards: int = 64) -> DataFrame:
    """(id, expiry, live): a row when an entry comes (live) and one when it expires. ``seconds`` after its ts an entry is gone.

    Entries are dealt to shards by a hash of their id, so a frequent user is no hot key.
    """
    forever = F.lit((1 << 62))
    expiry = F.coalesce(F.unix_millis("ts") + seconds * 1000, forever)
    rows = stream.select(F.col(id_col).cast("long").alias("id"), "ts", expiry.alias("expiry"), F.pmod(F.xxhash64(id_col), F.lit(shards)).alias("shard"))
    return keyed(rows, ["shard"], Expiring(), "id bigint, expiry bigint, live boolean", timers=True)


class Breaker(_Processor):
    """A circuit breaker for each key; a timer makes an open one half open, though no call comes."""

    def __init__(self, key: str, failures: int, recovery: float, successes: int):
        self.key, self.failures, self.recovery, self.successes = key, failures, recovery, successes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "name string, failed int, good int, last double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else ("closed", 0, 0, 0.0)
        before, calls, shown = state, sorted(_rows(rows, ["us", "id", "ok"])), []
        for us, _, ok in calls:
            state, got = breaker_step(state, (us / 1e6, ok), self.failures, self.recovery, self.successes)
            shown.append(got)
        self.state.update(state)
        if state[0] == "open" and state != before:
            self.handle.registerTimer(due(int((state[3] + self.recovery) * 1000)))
        yield pd.DataFrame({self.key: [key[0]] * len(calls), "id": pd.array([c[1] for c in calls], "Int64"), "accepted": pd.array([x[0] for x in shown], "boolean"), "state": [x[1] for x in shown]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        name, failed, good, last = self.state.get()
        # a timer of an earlier opening finds the breaker closed, or opened again later
        if name == "open" and timerValues.getCurrentWatermarkInMs() + LATE >= (last + self.recovery) * 1000:
            self.state.update(("half_open", failed, 0, last))
            yield pd.DataFrame({self.key: [key[0]], "id": pd.array([None], "Int64"), "accepted": pd.array([None], "boolean"), "state": ["half_open"]})


def breaker(stream: DataFrame, by: str, id_col: str, ok: F.Column, failures: int = 5, recovery: float = 60.0, successes: int = 2) -> DataFrame:
    """(by, id, accepted, state): a row for each call, and one with a null id when a breaker becomes half open by its timer."""
    rows = stream.select(by, "ts", F.col(id_col).cast("long").alias("id"), F.unix_micros("ts").alias("us"), ok.alias("ok"))
    return keyed(rows, [by], Breaker(by, failures, recovery, successes), f"{by} {dict(stream.dtypes)[by]}, id bigint, accepted boolean, state string", timers=True)


class Tasks(_Processor):
    """The state machines of a range of task ids, a step result at a time; gives the state of each task after each batch that holds it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getListState("states", "task_id bigint, node int, status string, reflections int, steps bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {r[0]: (tuple(r[1:4]), r[4]) for r in map(tuple, self.states.get())}
        changed = {}
        # the tasks of a range are few, but the steps of one are not: they come sorted a task at a time
        for task, _, ok in sorted(_rows(rows, ["task_id", "step", "ok"]), key=lambda r: (str(r[0]), *r[1:])):
            task = None if task != task else task
            state, steps = changed.get(task) or held.get(task) or (task_start(), 0)
            changed[task] = task_step(state, ok), steps + 1
        held.update(changed)
        self.states.put([(task, *state, steps) for task, (state, steps) in held.items()])
        shown = [task_shown(state) for state, _ in changed.values()]
        yield pd.DataFrame({"task_id": pd.array([None if t is None else int(t) for t in changed], "Int64"), "node": [x[0] for x in shown], "status": [x[1] for x in shown], "reflections": [x[2] for x in shown], "version": [n for _, n in changed.values()]})


#: Task ids of one entry in the state store: each entry costs calls of the store, whatever it holds.
RANGE = 256


def tasks(stream: DataFrame) -> DataFrame:
    """(task_id, node, status, reflections, version) from step results (task_id, step, ok) that come in the order of the steps.

    State is kept by ranges of RANGE ids, so an entry of the store has no more tasks than that.
    """
    rows = stream.select("task_id", "step", "ok", F.floor(F.col("task_id") / RANGE).alias("_range"))
    return keyed(rows, ["_range"], Tasks(), "task_id bigint, node string, status string, reflections int, version bigint")


class Changed(_Processor):
    """The greatest value of each key; gives a row only when a batch brings a key that is new or has a greater one."""

    def __init__(self, key: str, value: str):
        self.key, self.value = key, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "value bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = max(v for v, in _rows(rows, [self.value]))
        if not self.seen.exists() or new > self.seen.get()[0]:
            self.seen.update((new,))
            yield pd.DataFrame({self.key: [key[0]], self.value: [new], "version": [new]})


def changed(stream: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, version): what an index has to upsert; the highest version of a key is the current one."""
    return keyed(stream.select(by, F.col(value).cast("long").alias(value)), [by], Changed(by, value), f"{by} {dict(stream.dtypes)[by]}, {value} bigint, version bigint")


def current(changes: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each key's highest version."""
    newest = F.max("version").over(Window.partitionBy(*by))
    return changes.withColumn("_newest", newest).where(F.col("version") == F.col("_newest")).drop("_newest", "version")


def still_live(changes: DataFrame) -> DataFrame:
    """(id): entries that have come and not expired."""
    return changes.groupBy("id").agg(F.bool_and("live").alias("live")).where("live").select("id")
