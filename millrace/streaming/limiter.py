"""A sliding-window limiter for each key: an event is accepted while fewer than ``hits`` accepted ones stand in the window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SCHEMA = "event_id bigint, user_id bigint, accepted boolean"


def _accept(us: int, recent: deque[int], hits: int, span: int) -> bool:
    """Whether an event at ``us`` passes; refused events leave no mark. ``recent`` never holds over ``hits`` times."""
    while recent and recent[0] <= us - span:
        recent.popleft()
    if len(recent) >= hits:
        return False
    recent.append(us)
    return True


def timed(events: DataFrame, *keep: str) -> DataFrame:
    """The events with a user and a time, their time in microseconds."""
    known = events.where("user_id is not null and ts is not null")
    return known.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *keep)


def limit(events: DataFrame, hits: int = 10, seconds: int = 300) -> DataFrame:
    """event_id, user_id, accepted of a table of events (event_id, user_id, ts), by time and, at ties, by id.

    Events without user or time are left out. A user's events are read in order, a batch at a time, with only the
    last accepted times in memory, however many events a user has.
    """
    span = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = None, deque()
        for b in batches:
            passed = []
            for u, us in zip(b["user_id"].tolist(), b["us"].tolist(), strict=True):
                if u != user:
                    user, recent = u, deque()
                passed.append(_accept(us, recent, hits, span))
            yield b[["event_id", "user_id"]].assign(accepted=passed)

    ordered = timed(events).repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    return ordered.mapInPandas(run, _SCHEMA)


def limit_stream(events: DataFrame, hits: int = 10, seconds: int = 300) -> DataFrame:
    """The same over a stream. Within a micro-batch events are taken by time; the batches' own order is kept."""
    span = seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["us", "event_id"])
        passed = [_accept(us, recent, hits, span) for us in rows["us"].tolist()]
        state.update((list(recent),))
        yield rows[["event_id", "user_id"]].assign(accepted=passed)

    return timed(events).groupBy("user_id").applyInPandasWithState(
        run, _SCHEMA, "recent array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
