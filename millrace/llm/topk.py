"""Exact top-k by inner product over an index keyed by the nearest pivot and the distance to it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import join_spread, row_key, running_before, spool


#: Up to here sums of products are exact as floats; up to the next they are as 64-bit integers.
FLOAT_EXACT, LONG_EXACT = 2.0**52, 2.0**63 * (1 - 2.0**-20)


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as long, of the vectors that take part; a written table.

    Those are all without null or non-finite components; a null id takes part too. Shorter vectors are filled up with
    zeros. A vector whose squared length is over ``LONG_EXACT`` raises a ValueError: a score might not fit a long.
    """
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * F.lit(scale))
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("raw"), x.alias("x"))
    usable = usable.where(F.col("raw").isNotNull() & ~F.exists("raw", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    most = usable.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + (F.abs(c) + 1) * (F.abs(c) + 1))).alias("m2"), F.max(F.size("x")).alias("width")).first()
    if (most.m2 or 0) > LONG_EXACT:
        raise ValueError(f"components times {scale} are so large that scores may not fit 64 bits")
    v = F.concat(F.transform("x", lambda c: F.floor(c)), F.array_repeat(F.lit(0).cast("long"), F.lit(most.width or 0) - F.size("x")))
    return spool(usable.select("vec_id", v.alias("v")), "quantized")


def _matrix(column: pa.Array | pd.Series, dtype=float) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else column.tolist()
    return np.array(rows, dtype).reshape(len(rows), len(rows[0]) if rows else 0)


class Pivots:
    """Vectors x become (x, sqrt(m2 - |x|^2)), all of norm m; a query q becomes (q, 0). Then
    d(q, x)^2 = |q|^2 + m2 - 2 q.x, so the nearest vectors are those of the largest inner product."""

    def __init__(self, points: np.ndarray, m2: float):
        self.points, self.m2 = points, m2
        self.room = 1e-6 * np.sqrt(m2)  # more than rounding moves a distance by
        self.lift = np.sqrt(np.maximum(0, m2 - (points**2).sum(axis=1)))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.m2 - (x**2).sum(axis=1)))
        return np.sqrt(np.maximum(0, 2 * self.m2 - 2 * (x @ self.points.T + np.outer(lift, self.lift))))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (q**2).sum(axis=1)[:, None] + self.m2 - 2 * q @ self.points.T))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far a vector may lie that scores ``score`` or more, with room for rounding."""
        d2 = np.maximum(0, (q**2).sum(axis=1) + self.m2 - 2 * score)
        return np.sqrt(d2 + self.room**2) * (1 + 1e-9) + 2 * self.room


def _search_unit(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, pivots: Pivots, step: int = 256) -> pd.DataFrame:
    """The k best of one block of one pivot's annuli for each query: annuli are taken in order of their distance from
    the query's own, and each query stops where the triangle inequality rules out the rest."""
    out = {"query": [], "vector": [], "score": []}
    kind = float if pivots.m2 < FLOAT_EXACT else np.int64  # either way sums of products are exact
    vectors = vectors.sort_values(["dist", "vector"])
    x, dist, names = _matrix(vectors["v"], kind), vectors["dist"].to_numpy(), vectors["vector"].tolist()
    q, at = _matrix(queries["v"], kind), queries["at"].to_numpy(float)
    floor = queries["floor"].to_numpy(float)
    best: list[list[tuple[float, bytes]]] = [[] for _ in at]
    annuli = [(dist[i], dist[min(i + step, len(dist)) - 1], i) for i in range(0, len(dist), step)]
    low, high = np.array([a[0] for a in annuli]), np.array([a[1] for a in annuli])
    gap = np.maximum(0, np.maximum(low[None, :] - at[:, None], at[:, None] - high[None, :]))  # least distance to each
    order = gap.argsort(axis=1, kind="stable")
    length = q.astype(float)
    for turn in range(len(annuli)):
        reach = pivots.reach(length, floor)
        now = order[:, turn]
        open_ = gap[np.arange(len(at)), now] <= reach
        for n in np.unique(now[open_]):
            rows = (open_ & (now == n)).nonzero()[0]
            part = slice(annuli[n][2], annuli[n][2] + step)
            scores = q[rows] @ x[part].T
            for r, s in zip(rows.tolist(), scores, strict=True):
                good = (s >= floor[r]).nonzero()[0]
                if not len(good):
                    continue
                if len(good) > k:  # scores below the k-th best of these cannot be among the k best
                    good = good[s[good] >= np.partition(s[good], len(good) - k)[len(good) - k]]
                best[r] += [(int(s[g]), names[part.start + g]) for g in good]
                if len(best[r]) >= k:
                    kth = sorted((s for s, _ in best[r]), reverse=True)[k - 1]
                    best[r] = [b for b in best[r] if b[0] >= kth]  # ties stay: which of them win is for the ids to say
                    floor[r] = max(floor[r], _not_above(kth))
    for query, rows in zip(queries["query"], best, strict=True):
        for s, name in rows:
            out["query"].append(query)
            out["vector"].append(name)
            out["score"].append(s)
    return pd.DataFrame(out).astype({"query": object, "vector": object, "score": "int64"})


def _not_above(score: int) -> float:
    """The score as a float that is not larger."""
    return float(score) if abs(score) < FLOAT_EXACT else float(np.nextafter(float(score), -np.inf))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, sample: int = 2048, pivots: int = 32, block: int = 2048,
    query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each query by integer inner product, ties to the
    smaller id, null last; all others if there are fewer. ``is_query`` is a condition on vec_id, which is not null then.

    See ``quantized`` for which vectors take part; scores are exact. Rows count one by one: rows of one id are
    candidates of each other, each with its own vector, and each is a query with rows of its own in the result, so an
    id that repeats has its ranks as often. Other columns are left out; an empty table gives an empty result.

    Equal vectors are searched once and stand for their k + 1 smallest ids, as no result needs more of them. Pivots
    and first bounds come from a sample of at most ``sample`` vectors on the driver; every vector is in the index.
    Each query meets only the blocks its bounds admit, and results are merged from k + 1 vectors a block, and those
    that tie with the last of them.
    """
    return _ranked(*_searched(vectors, is_query, k, scale, sample, pivots, block, query_block, id_col, vector_col)[:3], k)


def pruned_share(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, sample: int = 2048, pivots: int = 32, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of (query, block) pairs that the bounds rule out before any score is computed."""
    *_, admitted, blocks, queries = _searched(vectors, is_query, k, scale, sample, pivots, block, 1024, id_col, vector_col)
    pairs = blocks.count() * queries.count()
    return 1 - admitted.count() / pairs if pairs else 0.0


def _searched(vectors, is_query, k, scale, sample, pivots, block, query_block, id_col, vector_col):
    """The valid rows, the distinct vectors with their ids, and (query, vector, score) of the vectors that may be among a query's best."""
    rows = quantized(vectors, id_col, vector_col, scale).withColumn("vector", row_key(F.array_join("v", ",")))
    rows = spool(rows, "rows")
    # a vector's k + 1 smallest ids: first of each part of its rows, so that no task holds all the rows of one
    n = {"_part": F.pmod(F.xxhash64("vec_id"), F.lit(64)), "vector": F.col("vector")}
    few = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("vec_id").isNull(), "vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    firsts = few(few(rows.withColumn("_part", n["_part"]), "vector", "_part"), "vector")
    distinct = spool(firsts.groupBy("vector").agg(F.first("v").alias("v"), F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("ids")), "vectors")
    m2 = distinct.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).first()[0] or 0.0
    taken = _matrix(distinct.orderBy("vector").limit(sample).select("v").toPandas()["v"])
    index = Pivots(taken[:pivots], m2)

    def key_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = index.of_vectors(_matrix(b.column(1)))
            near = d.argmin(axis=1) if len(d) else np.empty(0, int)
            new = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "pivot", "dist"])

    keyed = distinct.select("vector", "v").mapInArrow(key_vectors, "vector binary, v array<bigint>, pivot int, dist double")
    width = 2 * float(np.sqrt(m2)) / 512 or 1.0
    keyed = spool(keyed.withColumn("ring", F.floor(F.col("dist") / width)), "keyed")
    ranked = running_before(keyed, ["pivot"], "ring", ["dist", "vector"], F.lit(1), "place").withColumn("block", F.floor(F.col("place") / block))
    ranked = spool(ranked.select("vector", "v", "pivot", "dist", "block"), "annuli")
    blocks = ranked.groupBy("pivot", "block").agg(F.min("dist").alias("low"), F.max("dist").alias("high"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column(1))
            if len(taken) > k:  # k others of the sample score this much or more; floats may be off by room
                floor = np.concatenate([np.partition(q[i : i + 256] @ taken.T, len(taken) - k - 1, axis=1)[:, len(taken) - k - 1] for i in range(0, len(q), 256)])
                floor -= 1e-12 * m2
                reach = index.reach(q, floor)
            else:
                floor, reach = np.full(len(q), -np.inf), np.full(len(q), np.inf)
            d, n = index.of_queries(q), len(index.points)
            which = np.repeat(np.arange(len(q)), n)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(q))),
                    pa.array(d.ravel()), pa.array(np.repeat(floor, n)), pa.array(d.ravel() - reach[which]), pa.array(d.ravel() + reach[which]),
                ],
                ["query", "of", "at", "floor", "from", "to"],
            )

    queries = rows.where(is_query).select(F.col("vector").alias("query"), "v").dropDuplicates(["query"])
    queries = spool(queries, "queries")
    parts = max(1, -(-queries.count() // query_block))
    bounded = queries.mapInArrow(bounds, "query binary, of int, at double, floor double, `from` double, `to` double")
    unit = F.struct("pivot", "block", F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part"))
    meets = (F.col("of") == F.col("pivot")) & (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))
    admitted = spool(bounded.join(blocks, meets).select(unit.alias("unit"), "query", "at", "floor"), "admitted")
    units = admitted.select("unit").distinct()
    dealt = ranked.withColumnsRenamed({"pivot": "p", "block": "b"}).join(units, (F.col("p") == F.col("unit.pivot")) & (F.col("b") == F.col("unit.block")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_unit(left, right, k + 1, index)

    side = lambda df, *c: df.select(F.col("unit.pivot").alias("p"), F.col("unit.block").alias("b"), F.col("unit.part").alias("part"), *c)
    names = ("p", "b", "part")
    asking = admitted.join(queries, "query")
    found = (
        side(dealt, "v", "vector", "dist").groupBy(*names).cogroup(side(asking, "v", "query", "at", "floor").groupBy(*names)).applyInPandas(search, "query binary, vector binary, score long")
    )
    return rows.where(is_query), distinct, found, admitted, blocks, queries


def _ranked(asked: DataFrame, distinct: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each asking row, itself left out."""
    at_most = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "none", "vec_id"))
    ids = found.join(distinct.select("vector", "ids"), "vector").select("query", "vector", "score", F.inline("ids"))
    best = ids.withColumn("n", at_most).where(F.col("n") <= k + 1).drop("n")
    # the asking row itself stands among the rows of its own vector: one of its id is left out
    rows = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    rows = spool(rows.groupBy("query", "query_id").agg(F.count("*").alias("times")), "asking-rows")
    lists = best.groupBy("query").agg(F.collect_list(F.struct("vector", "score", "none", "vec_id")).alias("best"))
    lists = spool(lists.join(rows.groupBy("query").agg(F.count("*").alias("n")), "query"), "best")
    joined = join_spread(rows, lists, ["query"], "n", ["query_id"]).select("query", "query_id", "times", F.inline("best"))
    joined = joined.withColumn("own", (F.col("query") == F.col("vector")) & F.col("vec_id").eqNullSafe(F.col("query_id")))
    one = Window.partitionBy("query", "query_id")
    joined = joined.withColumn("nth", F.row_number().over(one.orderBy(F.desc("own"), "vec_id"))).where(~(F.col("own") & (F.col("nth") == 1)))
    joined = joined.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score"), "none", "vec_id"))).where(F.col("rank") <= k)
    again = joined.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return again.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
