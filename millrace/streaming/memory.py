"""Machines of a conversation's memory and of progress reports."""

from __future__ import annotations

from collections.abc import Callable

from millrace.streaming.machines import Machine

SECOND = 1_000_000
#: The first wait after a failed summary, and the longest.
FIRST_WAIT, LONGEST_WAIT = 60 * SECOND, 900 * SECOND


def token_estimate(text: str | None) -> int:
    """As ``functions.text.token_estimate``."""
    return max(1, int(len(text) / 1.5)) if text else 0


def wait(failures: int) -> int:
    """How long after so many failures in a row nothing is tried: each wait is twice the one before."""
    return min(LONGEST_WAIT, FIRST_WAIT << min(failures - 1, 10))


class SummaryCursor(Machine):
    """Summarises what has left the window of a conversation's newest turns, and moves a cursor past it.

    The window takes turns from the newest back while they fit ``window`` tokens; a newest turn that does not fit alone
    leaves all turns inside. Once the turns between cursor and window come to ``trigger`` tokens (their signs, by 1.5)
    ``summarise`` gets the last summary, (turn, role, text) of each, and how often it failed since; when it returns, the new summary and the cursor
    stand and what is left is looked at again, and when it raises, nothing moves and the conversation waits: 60 s, then
    twice as long each time, 900 s at most. A wait's end is a call of its own, if no turn comes before. A turn not above the
    highest one seen is a delivery that repeats, and is left out.
    """

    state = "summary string, cursor bigint, seen bigint, failures int, failed_at bigint, turns array<bigint>, roles array<string>, texts array<string>"
    start = (None, None, None, 0, None, [], [], [])
    columns = ("role", "text")
    schema = "at bigint, outcome string, from_turn bigint, to_turn bigint, messages int, failures int, summary string"

    def __init__(self, summarise: Callable[[str | None, list[tuple[int, str, str]], int], str], window: int, trigger: int):
        self.summarise, self.window, self.trigger = summarise, window, trigger

    def step(self, state: tuple, us: int, order: int, *values: str | None) -> tuple[list[tuple], tuple]:
        summary, cursor, seen, failures, failed_at, turns, roles, texts = state
        if order <= (cursor if seen is None and cursor is not None else seen if seen is not None else order - 1):
            return [], state
        role, text = values
        state = (summary, cursor, order, failures, failed_at, [*turns, order], [*roles, role or ""], [*texts, text or ""])
        return self._drain(state, us)

    def due(self, state: tuple) -> int | None:
        return None if state[4] is None else state[4] + wait(state[3])

    def ring(self, state: tuple, us: int) -> tuple[list[tuple], tuple]:
        out, state = self._drain(state, us)
        return out, state if out else (*state[:4], None, *state[5:])  # the window has closed meanwhile: the next turn will tell

    def _outside(self, texts: list[str]) -> int:
        """How many of the oldest turns are outside the window."""
        used, inside = 0, len(texts)
        while inside and used + token_estimate(texts[inside - 1]) <= self.window:
            used += token_estimate(texts[inside - 1])
            inside -= 1
        return inside if inside < len(texts) else 0

    def _drain(self, state: tuple, us: int) -> tuple[list[tuple], tuple]:
        out = []
        summary, cursor, seen, failures, failed_at, turns, roles, texts = state
        if failed_at is not None and us < failed_at + wait(failures):
            return out, state
        while (n := self._outside(texts)) and sum(map(len, texts[:n])) / 1.5 >= self.trigger:
            span = (turns[0], turns[n - 1], n)
            try:
                summary = self.summarise(summary, list(zip(turns[:n], roles[:n], texts[:n], strict=True)), failures)
            except Exception:
                failures, failed_at = failures + 1, us
                out.append((us, "failed", *span, failures, None))
                break
            cursor, failures, failed_at = turns[n - 1], 0, None
            turns, roles, texts = turns[n:], roles[n:], texts[n:]
            out.append((us, "summarised", *span, 0, summary))
        return out, (summary, cursor, seen, failures, failed_at, turns, roles, texts)


class Throttle(Machine):
    """Lets a report through if its bucket differs from that of the report before, or if it ends something."""

    state = "begun boolean, bucket bigint"
    start = (False, None)
    columns = ("bucket", "ends")
    schema = "event_id bigint, bucket bigint"

    def step(self, state: tuple, us: int, order: int, *values: int | bool | None) -> tuple[list[tuple], tuple]:
        bucket, ends = values
        last = state[1]
        through = last is None or (bucket is not None and bucket != last) or bool(ends)
        return ([(order, bucket)] if through else []), (True, bucket)
