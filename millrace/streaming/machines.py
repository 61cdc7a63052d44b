"""Machines that read a key's events in order of time, over tables and over streams, with equal rows.

A stream's events wait in state until the watermark has passed them, so they reach the machine in order of time however
they come; a timer stands for the next of them, or for when the machine itself wants to be called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """What is done with a key's events. ``state`` (DDL) is what is kept of a key, ``start`` its first value; ``columns`` are
    those of an event that ``step`` takes, ``schema`` (DDL) those of a row that it gives."""

    state: str
    start: tuple
    columns: tuple[str, ...]
    schema: str

    def step(self, state: tuple, us: int, order: int, *values: Any) -> tuple[list[tuple], tuple]:
        """The rows that an event at ``us`` (microseconds) gives, and the state after it."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When the machine wants to be called without an event, if at all."""
        return None

    def ring(self, state: tuple, us: int) -> tuple[list[tuple], tuple]:
        """The rows of a call that was due at ``us``, and the state after it."""
        return [], state


def advance(machine: Machine, kept: tuple, last: int | None, events: Iterable[tuple], until: int | None, idle: int | None) -> tuple[list[tuple], tuple, int | None]:
    """Rows, state and time of the last event after ``events`` (us, order, values) in order, and all calls due up to
    ``until``. A call due at the time of an event comes before it. After ``idle`` without an event a key starts anew."""
    out: list[tuple] = []

    def rung(kept: tuple, upto: int) -> tuple:
        while (at := machine.due(kept)) is not None and at <= upto:
            rows, kept = machine.ring(kept, at)
            out.extend(rows)
        return kept

    for us, order, *values in events:
        if last is not None and idle is not None and us - last > idle:
            rung(kept, last + idle)
            kept = machine.start
        kept = rung(kept, us)
        rows, kept = machine.step(kept, us, order, *values)
        out.extend(rows)
        last = us
    return out, kept if until is None else rung(kept, until), last


def _plain(value: Any) -> Any:
    """A value of a frame as Python's own; null as None."""
    if isinstance(value, np.ndarray | list | tuple):
        return [_plain(v) for v in value]
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if isinstance(value, np.generic) else value


def _fields(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names


def _timed(events: DataFrame, key: str, order: str, machine: Machine, time: str) -> DataFrame:
    known = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return known.select(F.col(key).alias("key"), us.alias("us"), F.col(order).cast("long").alias("order"), *machine.columns, F.col(time).cast("timestamp").alias("event_time"))


def _result(key: str, kind: str, machine: Machine) -> str:
    return f"`{key}` {kind}, {machine.schema}"


def over_table(
    events: DataFrame, key: str, machine: Machine, order: str = "event_id", time: str = "ts", until: int | None = None, idle: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """key and ``machine.schema``: the machine's rows for each key of a table, its events by time and then ``order``.

    Events without key or time are left out. A key's events pass by a batch at a time and only its state is held, so a key
    may have any number of them. ``until`` (microseconds): calls due up to then are made after the last event;
    ``idle`` (microseconds): see ``advance``; ``initial``: (key, the state's columns) to start some keys from.
    """
    kind, kept_names = events.schema[key].dataType.simpleString(), _fields(machine.state)
    timed = _timed(events, key, order, machine, time).drop("event_time")
    begins = initial is not None
    if begins:
        first = initial.select(F.col(key).alias("key"), F.struct(*kept_names).alias("first"))
        timed = timed.join(first, "key", "left")
    names = [*_fields(machine.schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, kept, last = None, machine.start, None
        for b in batches:
            rows: list[tuple] = []
            for k, part in b.groupby("key", sort=False):
                if k != key_now:
                    if key_now is not None:
                        rows += [(key_now, *r) for r in advance(machine, kept, last, [], until, idle)[0]]
                    begun = part["first"].iloc[0] if begins else None
                    key_now, kept, last = k, machine.start if begun is None else tuple(_plain(begun[n]) for n in kept_names), None
                found = (tuple(map(_plain, e)) for e in part[["us", "order", *machine.columns]].itertuples(index=False, name=None))
                out, kept, last = advance(machine, kept, last, found, None, idle)
                rows += [(k, *r) for r in out]
            yield pd.DataFrame(rows, columns=[key, *names])
        if key_now is not None:
            yield pd.DataFrame([(key_now, *r) for r in advance(machine, kept, last, [], until, idle)[0]], columns=[key, *names])

    return timed.repartition("key").sortWithinPartitions("key", "us", "order").mapInPandas(run, _result(key, kind, machine))


class InOrder(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then hands them to the machine in order."""

    def __init__(self, key: str, machine: Machine, events: StructType, idle: int | None):
        self.machine, self.events, self.idle = machine, events, idle
        self.names, self.kept_names = [key, *_fields(machine.schema)], _fields(machine.state)
        self.kept_type = StructType.fromDDL(f"last bigint, {machine.state}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.events)
        self.kept = handle.getValueState("kept", self.kept_type)

    def _ring_at(self, us: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if us is not None:
            self.handle.registerTimer(-(-us // 1000))

    def _now(self) -> tuple[int | None, tuple]:
        found = self.kept.get() if self.kept.exists() else None
        return (None, self.machine.start) if found is None else (found[0], tuple(_plain(v) for v in found[1:]))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        self.kept.update((None, *(_plain(row[n]) for n in self.kept_names)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(map(_plain, e)) for b in rows for e in b[self.events.names].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        due = self.machine.due(self._now()[1])
        next_ = min(e[0] for e in self.waiting.get())
        self._ring_at(next_ if due is None else min(next_, due))
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(_plain(v) for v in e) for e in self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in waiting if e[0] <= passed]
        left = waiting[len(ready) :]
        last, kept = self._now()
        rows, kept, last = advance(self.machine, kept, last, ready, passed, self.idle)
        self.kept.update((last, *kept))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        due = self.machine.due(kept)
        ahead = [t for t in (left[0][0] if left else None, due) if t is not None]
        self._ring_at(min(ahead, default=None))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)

    def close(self) -> None:
        pass


def over_stream(
    events: DataFrame, key: str, machine: Machine, delay: str, order: str = "event_id", time: str = "ts", idle: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """As ``over_table``, for a stream whose events come at most ``delay`` late (later ones are dropped): the rows of all
    events that the watermark has passed, and of all calls due by then. The state is RocksDB's: see ``run_to_table``."""
    kind = events.schema[key].dataType.simpleString()
    timed = _timed(events, key, order, machine, time).withWatermark("event_time", delay)
    held = StructType([timed.schema[c] for c in ("us", "order", *machine.columns)])
    first = None if initial is None else initial.select(F.col(key).alias("key"), *_fields(machine.state)).groupBy("key")
    return timed.groupBy("key").transformWithStateInPandas(
        InOrder(key, machine, held, idle), _result(key, kind, machine), outputMode="Append", timeMode="EventTime", initialState=first
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, spark: SparkSession) -> StreamingQuery:
    """Runs all that a stream has now, and the watermark's last move, into a Parquet folder; each batch is committed once."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return query
