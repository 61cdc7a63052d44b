"""Helpers the operators share: keys, written tables that are dealt by a key, joins on hot keys, and batches."""

from __future__ import annotations

import atexit
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranges import running_before
from millrace.sources.written import forget, shared_dir, spool

__all__ = ["WORD", "blocks", "bucketed", "join_spread", "list_views", "parallelism", "row_key", "running_before", "runs", "same", "shared_dir", "slices", "spool"]

#: What counts as a word throughout: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def same(a: list[Column], b: list[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    out = a[0].eqNullSafe(b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out & x.eqNullSafe(y)
    return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of a batch stays small however long texts are."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def blocks(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of one string column, and a text more at most."""
    for b in batches:
        begun = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(begun)) + 1).tolist(), b.num_rows]
        for start, stop in itertools.pairwise(edges):
            if stop > start:
                yield b.slice(start, stop - start)


def runs(batches: Iterable[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of ``by``, which stand together, as one batch."""
    held = None
    for b in batches:
        b = b if held is None else pa.concat_batches([held, b])
        key = b.column(by).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for start, stop in itertools.pairwise(edges):
            yield b.slice(start, stop - start)
        held = b.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held


def list_views(column: pa.ListArray) -> list[np.ndarray]:
    """A numpy view of each list of a column without nulls."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in itertools.pairwise(at.tolist())]


def row_key(*columns: Column) -> Column:
    """A 128-bit key (16 bytes) of a row's content, null and empty told apart: no two unlike rows of any corpus share one."""
    told = [F.coalesce(F.concat(F.length(s), F.lit("/"), s), F.lit("-")) for s in (c.cast("string") for c in columns)]
    return F.unhex(F.md5(F.concat(*told)))


def parallelism(spark: SparkSession) -> int:
    """How many partitions work that is not in proportion to bytes is dealt over; they are not coalesced."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def bucketed(df: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    """Like ``spool``, dealt by ``key``: later joins on it move the other side only. ``dealt``: ``df`` is the result of
    an aggregation by ``key``, which has dealt it already."""
    spark = df.sparkSession
    table, parts = f"{name}_{uuid.uuid4().hex}".replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{table}"
    rows = df if dealt else df.repartition(parts, key)
    rows.write.option("path", path).option("compression", "zstd").bucketBy(parts, key).saveAsTable(table)
    atexit.register(forget, spark, path)
    out = spark.table(table)  # resolved here, so the catalog's entry is no longer needed; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


#: A hot key is one that has over 1 / PIECES of all rows, so there are fewer than PIECES of them.
PIECES = 4096


def join_spread(many: DataFrame, one: DataFrame, keys: list[str], n: str, by: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has each of ``keys`` once and in ``n`` how many rows of ``many`` have it.

    Rows of a hot key are dealt by a hash of ``by`` over as many parts as it is larger than 1 / PIECES of all rows,
    and its row of ``one`` goes to each part. The hot keys are broadcast, fewer than PIECES rows; the copies in
    ``one`` are fewer than 2 * PIECES. Null keys meet nothing. ``one`` is read twice: pass a written table.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    step = max(1, total // PIECES)
    parts = F.ceil(F.col(n) / step).cast("int")
    hot = one.where(F.col(n) > step).select(*keys, parts.alias("_parts"))
    dealt = many.join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    sent = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(sent, [*keys, "_part"], how).drop("_part")
