"""Search of a stated set of queries over all rows, a block of queries at a time.

A block is at most ``size`` queries, which the driver reads and broadcasts; rows stay where they are. A task scores a
slice of its rows against the whole block with numpy and keeps the best of each query, so neither the pairs nor more
than ``k`` rows a query and partition are ever written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: scores[i, j] of row i of a slice beside query j of the block; NaN where the pair does not count.
Scorer = Callable[[pa.RecordBatch, object], np.ndarray]


def blocks(queries: DataFrame, size: int = 1024) -> Iterator[pd.DataFrame]:
    """``queries`` (query_id, ...) in parts of about ``size`` rows, dealt by a hash of query_id; an empty table has none."""
    parts = -(-queries.count() // size)
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).orderBy("query_id").toPandas()


class Best:
    """The ``k`` best rows of each query and group, by score, then by smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.held: list[pd.DataFrame] = []
        self.size = 0
        self.floor: np.ndarray | None = None  # the k-th best of each query so far

    def add(self, scores: np.ndarray, ids: np.ndarray, groups: np.ndarray | None) -> None:
        if groups is None and len(scores) > self.k:  # below the k-th best of a slice nothing can be among the k best
            kth = -np.sort(-np.where(np.isnan(scores), -np.inf, scores), axis=0)[self.k - 1]
            row, query = np.nonzero(scores >= (kth if self.floor is None else np.maximum(kth, self.floor)))
        else:
            row, query = np.nonzero(~np.isnan(scores))
        found = {"query": query, "id": ids[row], "score": scores[row, query], "group": 0 if groups is None else groups[row]}
        self.held.append(pd.DataFrame(found))
        self.size += len(row)
        if self.size > 100_000:
            full = self.prune()
            if groups is None:
                last = full[full.groupby("query").cumcount() == self.k - 1]
                self.floor = np.full(scores.shape[1], -np.inf)
                self.floor[last["query"].to_numpy(int)] = last["score"].to_numpy()

    def prune(self) -> pd.DataFrame:
        every = pd.concat(self.held) if self.held else pd.DataFrame({"query": [], "id": [], "score": [], "group": []})
        every = every.sort_values(["query", "score", "id"], ascending=[True, False, True])
        every = every[every.groupby(["query", "group"], dropna=False).cumcount() < self.k]
        self.held, self.size = [every], 0
        return every


def top_in_blocks(
    rows: DataFrame, blocks: Iterator[tuple[list, object]], scorer: Scorer, k: int, id_col: str = "doc_id", group: str | None = None, at_once: int = 128
) -> DataFrame:
    """query_id, id, score, rank (and the group) of the ``k`` best rows of each query (and group).

    ``blocks`` gives (ids of the queries, what the scorer takes). Scores are rounded to 6 digits before they are
    compared; ties go to the smaller id. Without queries the result is empty.
    """
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    out = None
    names = ["query_id", id_col, "score"] + ([group] if group else [])
    schema = f"query_id bigint, {id_col} {kind}, score double" + (f", {group} {rows.schema[group].dataType.simpleString()}" if group else "")

    def scan(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, block = sent.value
            best = Best(k)
            for b in batches:
                for start in range(0, b.num_rows, at_once):
                    part = b.slice(start, at_once)
                    ids = part.column(part.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False)
                    groups = part.column(part.schema.get_field_index(group)).to_numpy(zero_copy_only=False) if group else None
                    best.add(np.round(scorer(part, block), 6), ids, groups)
            kept = best.prune()
            columns = [np.array(queries, np.int64)[kept["query"].to_numpy(int)], kept["id"], kept["score"]] + ([kept["group"]] if group else [])
            yield pa.RecordBatch.from_pandas(pd.DataFrame(dict(zip(names, columns, strict=True))), preserve_index=False)

        return rows.mapInArrow(run, schema)

    for block in blocks:
        found = scan(spark.sparkContext.broadcast(block))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id", *([group] if group else [])).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row that each is of."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), size)


def _product(rows: int, row: np.ndarray, dim: np.ndarray, weight: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense block (dimensions x queries); NaN where they have no dimension in common."""
    out = np.zeros((rows, block.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(block[dim] * weight[:, None], starts, axis=0)
    out[out <= 0] = np.nan
    return out


class Terms:
    """A block's queries by their terms, which are known by their place in ``names``: what a row has in common with each
    query costs as much as the common terms, not as the block."""

    def __init__(self, names: pa.Array, lists: Sequence[Sequence[str]], weights: Sequence[np.ndarray] | None = None):
        self.names, self.many = names, len(lists)
        code = pc.index_in(pa.array([t for ts in lists for t in ts], pa.string()), names).to_numpy(zero_copy_only=False).astype(np.int64)
        query = np.repeat(np.arange(self.many), [len(ts) for ts in lists])
        weight = np.ones(len(code)) if weights is None else np.concatenate([*weights, np.zeros(0)])
        order = np.argsort(code, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.starts = np.searchsorted(code[order], np.arange(len(names) + 1))

    def _keys(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each term that a row and a query have in common: its place in the row's terms, in ours, and the pair's number."""
        size = self.starts[code + 1] - self.starts[code]
        which = np.repeat(np.arange(len(code)), size)
        at = np.arange(len(which)) + np.repeat(self.starts[code] - (np.cumsum(size) - size), size)
        return which, at, row[which] * self.many + self.query[at]

    def met(self, rows: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """rows x queries: the sums of the products of the weights of common terms."""
        which, at, key = self._keys(row, code)
        return np.bincount(key, weight[which] * self.weight[at], rows * self.many).astype(float, copy=False).reshape(rows, self.many)

    def met_twice(self, rows: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``met``, and the numbers of common terms."""
        which, at, key = self._keys(row, code)
        sums = np.bincount(key, weight[which] * self.weight[at], rows * self.many).astype(float, copy=False)
        return sums.reshape(rows, self.many), np.bincount(key, minlength=rows * self.many).reshape(rows, self.many)


def bm25_scores(saturated: Callable) -> Scorer:
    """Sums over common terms of a query's weight of the term, times what its count (tf) weighs in a row of n words."""

    def score(part: pa.RecordBatch, block: Terms) -> np.ndarray:
        code, row = _ragged(part.column(part.schema.get_field_index("terms")))
        tf, _ = _ragged(part.column(part.schema.get_field_index("tf")))
        n = part.column(part.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
        out = block.met(part.num_rows, row, code, saturated(tf.astype(float), n[row].astype(float)))
        out[out <= 0] = np.nan
        return out

    return score


def share_scores(least: float) -> Scorer:
    """The share of a query's terms that a row (``entity``) has, from ``least``."""

    def score(part: pa.RecordBatch, block: tuple[Terms, np.ndarray]) -> np.ndarray:
        terms, sizes = block
        values = part.column(part.schema.get_field_index("entity"))
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(values).to_numpy(zero_copy_only=False))
        code = pc.fill_null(pc.index_in(values.flatten(), terms.names), -1).to_numpy(zero_copy_only=False)
        known = code >= 0
        out = terms.met(part.num_rows, row[known], code[known], np.ones(known.sum())) / sizes[None, :]
        out[np.round(out, 6) < least] = np.nan
        return out

    return score


def unit_counts(dims: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, weight) of lists of dimensions with repeats: their counts, scaled to length 1 in each row."""
    dim, row = _ragged(dims)
    key, n = np.unique(row * size + dim, return_counts=True)
    row, dim = key // size, key % size
    length = np.sqrt(np.bincount(row, n.astype(float) ** 2, len(dims)))
    return row, dim, n / length[row]


def count_scores(size: int, dims: str = "dims") -> Scorer:
    """Cosines of bags of dimensions (lists with repeats) with a block of unit vectors, ``size`` x queries."""

    def score(part: pa.RecordBatch, block: np.ndarray) -> np.ndarray:
        row, dim, weight = unit_counts(part.column(part.schema.get_field_index(dims)), size)
        return _product(part.num_rows, row, dim, weight, block)

    return score


def cosine_scores(vector: str = "v", own: str | None = None) -> Scorer:
    """Cosines of dense rows with a block (vectors of the queries, their ids); 0 where a vector has no length. A row whose
    ``own`` column is the query's id does not count."""

    def score(part: pa.RecordBatch, block: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        queries, ids = block
        x = np.array(part.column(part.schema.get_field_index(vector)).to_pylist(), float).reshape(part.num_rows, -1)
        length = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        out = np.divide(x @ queries.T, length, out=np.zeros_like(length), where=length > 0)
        if own:
            mine = part.column(part.schema.get_field_index(own)).to_numpy(zero_copy_only=False)
            out[mine[:, None] == ids[None, :]] = np.nan
        return out

    return score
