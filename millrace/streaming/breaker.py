"""A circuit breaker for each key, over tables and streams of calls that succeed or fail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.streaming.limiter import timed

_SCHEMA = "event_id bigint, user_id bigint, allowed boolean, state string"
START = ("closed", 0, 0)


def step(now: tuple[str, int, int], us: int, failed: bool, failures: int, cooldown: int) -> tuple[bool, tuple[str, int, int]]:
    """Whether a call at ``us`` is let through, and what is (state, failures in a row, time of the last one) after it.

    A breaker opens at ``failures`` in a row and refuses calls, which leave no mark, for ``cooldown`` after the last
    failure. The first call after that is a probe: it closes the breaker or opens it again.
    """
    state, count, last = now
    if state == "open" and us - last < cooldown:
        return False, now
    if not failed:
        return True, ("closed", 0, last)
    probe = state == "open"
    return True, ("open" if probe or count + 1 >= failures else "closed", count + 1, us)


def _calls(events: DataFrame, failed: Column) -> DataFrame:
    marked = events.withColumn("failed", F.coalesce(failed, F.lit(False)))
    return timed(marked, "failed")


def breaker(events: DataFrame, failed: Column, failures: int = 10, seconds: int = 30) -> DataFrame:
    """event_id, user_id, allowed, state after it, of each event with a user and a time. A user's events pass by in
    order and only the state is held; null counts as no failure."""
    cooldown = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, now = None, START
        for b in batches:
            allowed, states = [], []
            for u, us, bad in zip(b["user_id"].tolist(), b["us"].tolist(), b["failed"].tolist(), strict=True):
                if u != user:
                    user, now = u, START
                ok, now = step(now, us, bad, failures, cooldown)
                allowed.append(ok)
                states.append(now[0])
            yield b[["event_id", "user_id"]].assign(allowed=allowed, state=states)

    ordered = _calls(events, failed).repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    return ordered.mapInPandas(run, _SCHEMA)


def breaker_stream(events: DataFrame, failed: Column, failures: int = 10, seconds: int = 30) -> DataFrame:
    """The same over a stream. Within a micro-batch events are taken by time; the batches' own order is kept."""
    cooldown = seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else START
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["us", "event_id"])
        allowed, states = [], []
        for us, bad in zip(rows["us"].tolist(), rows["failed"].tolist(), strict=True):
            ok, now = step(now, us, bad, failures, cooldown)
            allowed.append(ok)
            states.append(now[0])
        state.update(now)
        yield rows[["event_id", "user_id"]].assign(allowed=allowed, state=states)

    return _calls(events, failed).groupBy("user_id").applyInPandasWithState(
        run, _SCHEMA, "state string, count bigint, last bigint", "append", GroupStateTimeout.NoTimeout
    )
