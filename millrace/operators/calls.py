"""Calls of a model over a table: in batches, with retries, one text at a time where a batch fails, errors as a column."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: What a caller brings: a vector for each text of a batch, or an exception for all of them.
Model = Callable[[list[str]], list[list[float]]]


class TemporaryError(Exception):
    """A refusal that may pass: too many requests, a server that is not well. ``after``: seconds it asks to wait."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after

    def __reduce__(self):
        return TemporaryError, (*self.args, self.after)


class OpenCircuitError(Exception):
    """No call was made, as too many failed in a row."""


class Caller:
    """The calls of one task: retries with growing waits, and a breaker that ends them once ``most_failures`` in a row
    failed (None: never)."""

    def __init__(self, model: Model, retries: int, wait: float, most_failures: int | None, sleep: Callable[[float], None]):
        self.model, self.retries, self.wait, self.most_failures, self.sleep = model, retries, wait, most_failures, sleep
        self.failed = 0

    def call(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            if self.most_failures is not None and self.failed >= self.most_failures:
                raise OpenCircuitError("circuit open")
            try:
                found = self.model(texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                self.failed = 0
                return found
            except TemporaryError as e:
                if attempt == self.retries:
                    self.failed += 1
                    raise
                self.sleep((e.after if e.after is not None else self.wait * 2**attempt) * (1 + random.random() / 4))
        raise AssertionError("unreachable")

    def vectors(self, texts: list[str]) -> Iterator[tuple[list[float] | None, str | None]]:
        """(vector, None) or (None, what went wrong) of each text, in order."""
        try:
            yield from ((v, None) for v in self.call(texts))
            return
        except Exception as e:  # a batch fails as a whole: each text then has a call of its own
            if len(texts) == 1:
                yield None, str(e) or type(e).__name__
                return
        for text in texts:
            try:
                yield self.call([text])[0], None
            except Exception as e:
                yield None, str(e) or type(e).__name__


def with_vectors(
    rows: DataFrame, model: Model, text_col: str = "text", batch: int = 32, retries: int = 3, wait: float = 1.0, tasks: int | None = None,
    most_failures: int | None = None, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``rows`` with ``vector`` and ``error``, of which one is null; columns of these names are replaced.

    A task calls the model with ``batch`` texts at a time, over the borders of Arrow's batches, so it makes as few calls
    as its rows allow; refusals that may pass are tried again up to ``retries`` times, and a batch that fails is called
    text by text, so one bad text costs no other its vector. Null texts are not sent: their error is ``no text``.
    ``tasks`` bounds how many calls run at once; rows are dealt anew then. A task that is run again calls again: the
    result of a call that is not repeatable should be written before it is read twice.
    """
    base = rows.drop("vector", "error")
    dealt = base.repartition(tasks) if tasks else base
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(model, retries, wait, most_failures, sleep)

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            texts = table.column(at).to_pylist()
            found = caller.vectors([t for t in texts if t is not None]) if any(t is not None for t in texts) else iter(())
            pairs = [(None, "no text") if t is None else next(found) for t in texts]
            out = table.append_column("vector", pa.array([v for v, _ in pairs], pa.list_(pa.float64()))).append_column("error", pa.array([e for _, e in pairs], pa.string()))
            yield from out.combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            start = 0
            while size + b.num_rows - start >= batch:
                held.append(b.slice(start, batch - size))
                start += batch - size
                yield from done(pa.Table.from_batches(held))
                held, size = [], 0
            if start < b.num_rows:
                held.append(b.slice(start))
                size += b.num_rows - start
        if held:
            yield from done(pa.Table.from_batches(held))

    new = [StructField("vector", ArrayType(DoubleType())), StructField("error", StringType())]
    schema = StructType([*base.schema.fields, *new])
    return dealt.mapInArrow(run, schema)
