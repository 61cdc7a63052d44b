"""Exact near-duplicate vectors of a label by a cover tree over all of them and dual traversal of its nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bktree import local_components
from millrace.llm.common import join_spread, spool
from millrace.llm.components import components
from millrace.llm.covertree import ROOM, CoverTree, chord, links, nested_centers

NODE = "node string, parent string, idx int, radius double, weight bigint, rep binary, center array<double>"


def unit_vectors(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, v of all rows: v is the vector at length 1 as bytes of doubles, null where it takes no part."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("x"))
    usable = F.col("label").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists("x", lambda c: c != 0)
    rows = rows.withColumn("x", F.when(usable, F.col("x")))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, max(width, 0)))
            lists, there = b.column(2), ~b.column(2).is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(there, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            x[np.arange(x.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            x /= np.where(there, np.abs(x).max(axis=1, initial=0), 1)[:, None]  # so that no square is too large
            x /= np.where(there, np.sqrt((x * x).sum(axis=1)), 1)[:, None]
            x += 0.0  # no negative zeros
            v = pa.array([r.tobytes() if ok else None for r, ok in zip(x, there.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), v], ["vec_id", "label", "v"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {id_type}, label string, v binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), float).reshape(len(column), -1)


def _chosen(x: np.ndarray, many: int) -> np.ndarray:
    """Rows of the sample as centers: half of them as far from the others as can be, the rest as the sample has them,
    so that outliers get nodes of their own and a crowd is still parted."""
    taken = [0]
    far = chord(x @ x[0])
    while len(taken) < -(-many // 2) and far.max() > ROOM:
        taken.append(int(far.argmax()))
        far = np.minimum(far, chord(x @ x[taken[-1]]))
    rest = [i for i in range(len(x)) if i not in set(taken)]
    return np.array([*taken, *rest[: many - len(taken)]])


def grown_tree(points: DataFrame, block: int, fan_out: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """The leaves (node, vector, v, n) and the nodes below the roots, of ``points`` (node, vector, v, n).

    A node of more than ``block`` vectors is parted among centers from about ``sample`` of its own, each vector going to
    the nearest; so are its children, until none is too large. Vectors of a large node are dealt over many tasks, and
    its centers, ``fan_out`` at most, go to each. A node's radius is the largest distance from its center of all its
    vectors, not of a sample. Vectors that no center tells apart are dealt by hash.
    """
    spark = points.sparkSession
    open_, done, inner = points, [], []

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order")
        x, size = _matrix(rows["v"]), int(rows["size"].iloc[0])
        at = _chosen(x, min(fan_out, max(2, 2 * -(-size // block))))
        return pd.DataFrame({"parent": key[0], "idx": np.arange(len(at), dtype=np.int32), "center": [x[i].tolist() for i in at], "units": rows["units"].iloc[0]})

    def assign(rows: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        centers = centers.sort_values("idx")
        x, c = _matrix(rows["v"]), np.array(centers["center"].tolist())
        far = chord(x @ c.T)
        if chord(c @ c[0]).max() <= ROOM:
            idx = np.frombuffer(b"".join(k[:4] for k in rows["vector"]), np.uint32) % np.uint32(max(2, fan_out))
            dist = far[:, 0]
        else:
            idx = far.argmin(axis=1)
            dist = far[np.arange(len(x)), idx]
        return pd.DataFrame({"parent": rows["parent"], "vector": rows["vector"], "v": rows["v"], "n": rows["n"], "idx": idx.astype(np.int32), "dist": dist})

    for _ in range(64):
        big = spool(open_.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > block), "large-nodes")
        if big.isEmpty():
            break
        done.append(open_.join(big, "node", "left_anti"))
        sizes = big.withColumnRenamed("node", "parent").withColumn("units", F.ceil(F.col("size") / 4096).cast("int"))
        parted = open_.withColumnRenamed("node", "parent").join(sizes, "parent")
        order = F.xxhash64("vector")
        sampled = parted.where(F.pmod(order, F.ceil(F.col("size") / sample)) == 0).withColumn("order", order)
        centers = spool(sampled.groupBy("parent").applyInPandas(choose, "parent string, idx int, center array<double>, units int"), "centers")
        dealt = parted.withColumn("unit", F.pmod(F.xxhash64("vector", F.lit(1)), F.col("units")).cast("int"))
        copies = centers.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
        keys = ("parent", "unit")
        found = dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(assign, "parent string, vector binary, v binary, n bigint, idx int, dist double")
        found = spool(found.withColumn("node", F.concat_ws(".", "parent", "idx")), "assigned")
        stats = found.groupBy("node", "parent", "idx").agg(F.max("dist").alias("radius"), F.sum("n").alias("weight"), F.min("vector").alias("rep"))
        first = centers.where("idx = 0").select("parent", F.col("center").alias("first"))  # of vectors dealt by hash
        joined = stats.join(centers.drop("units"), ["parent", "idx"], "left").join(first, "parent")
        inner.append(joined.select("node", "parent", "idx", "radius", "weight", "rep", F.coalesce("center", "first").alias("center")))
        open_ = found.select("node", "vector", "v", "n")
    else:
        raise RuntimeError("nodes did not get smaller")
    leaves, nodes = open_, spark.createDataFrame([], NODE)
    for part in done:
        leaves = leaves.unionByName(part)
    for part in inner:
        nodes = nodes.unionByName(part)
    return spool(leaves, "leaves"), spool(nodes, "nodes")


def node_pairs(roots: DataFrame, nodes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of leaves (a, b) that may hold vectors within ``reach``, and pairs of nodes all of whose vectors are.

    Pairs go down level by level from each root with itself: those whose centers lie further apart than the reach and
    both radii go, those that lie within it by both radii are kept whole, and the others meet each other's children.
    """
    parents = nodes.select(F.col("parent").alias("node")).distinct()
    told = nodes.join(parents.withColumn("inner", F.lit(True)), "node", "left").select(
        "parent", F.struct("node", "center", "radius", "weight", "rep", F.col("inner").isNull().alias("leaf")).alias("kid")
    )
    kids = told.groupBy(F.col("parent").alias("node")).agg(F.collect_list("kid").alias("kids"))  # at most a fan-out
    kids = spool(kids.unionByName(told.where("kid.leaf").select("kid.node", F.array("kid").alias("kids"))), "kids")
    start = roots.join(parents.withColumn("inner", F.lit(True)), "node", "left")
    leaf_roots = start.where("inner IS NULL").select(F.col("node").alias("a"), F.col("node").alias("b"))
    todo = start.where("inner").select(F.col("node").alias("a"), F.col("node").alias("b"))
    units, whole = [leaf_roots], []
    dot = F.expr("aggregate(zip_with(x.center, y.center, (p, q) -> p * q), 0D, (s, p) -> s + p)")
    far = F.when(F.col("x.node") == F.col("y.node"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)))
    while not todo.isEmpty():
        both = todo.join(kids.select(F.col("node").alias("a"), F.col("kids").alias("of_a")), "a").join(kids.select(F.col("node").alias("b"), F.col("kids").alias("of_b")), "b")
        pairs = both.select("a", "b", F.explode("of_a").alias("x"), "of_b").select("a", "b", "x", F.explode("of_b").alias("y"))
        pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("x.node") <= F.col("y.node"))).withColumn("far", far)
        radii = F.col("x.radius") + F.col("y.radius")
        near = pairs.where(F.col("far") - radii <= reach + ROOM).select(
            F.col("x.node").alias("a"), F.col("y.node").alias("b"), (F.col("x.leaf") & F.col("y.leaf")).alias("leaves"), (F.col("far") + radii <= reach - ROOM).alias("whole"),
            *(F.col(f"{s}.{c}").alias(f"{c}_{t}") for s, t in (("x", "a"), ("y", "b")) for c in ("weight", "rep")),
        )
        near = spool(near, "node-pairs")
        whole.append(near.where("whole").select("a", "b", "weight_a", "weight_b", "rep_a", "rep_b"))
        units.append(near.where("leaves AND NOT whole").select("a", "b"))
        todo = near.where("NOT leaves AND NOT whole").select("a", "b")
    wholes = roots.sparkSession.createDataFrame([], "a string, b string, weight_a bigint, weight_b bigint, rep_a binary, rep_b binary")
    for part in whole:
        wholes = wholes.unionByName(part)
    found = units[0]
    for part in units[1:]:
        found = found.unionByName(part)
    return found, spool(wholes, "whole-pairs")


def leaf_links(leaves: DataFrame, units: DataFrame, least_dot: float) -> DataFrame:
    """vector, links, joined: how much each vector links with in each unit of two leaves, and a vector it is joined with."""
    reach = float(chord(np.array(least_dot)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vector")
        return rows.assign(way=nested_centers(_matrix(rows["v"]), reach / 4).astype(np.int32).tolist())

    def tree(rows: pd.DataFrame) -> CoverTree:
        return CoverTree(_matrix(rows["v"]), np.array(rows["way"].tolist()), rows["n"].to_numpy())

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows["side"] == s].sort_values("vector") for s in (0, 1))
        first = tree(a)
        same = not len(b)
        found = links(first, first if same else tree(b), least_dot)
        shift = 0 if same else len(a)
        names = a["vector"].tolist() + ([] if same else b["vector"].tolist())
        edges = [found.between + [0, shift], found.within_a, *([] if same else [found.within_b + shift])]
        root = local_components(len(names), ((e[i : i + 65536, 0], e[i : i + 65536, 1]) for e in edges for i in range(0, len(e), 65536)))
        got = np.concatenate([found.of_a, *([] if same else [found.of_b])])
        there = np.flatnonzero(got)
        return pd.DataFrame({"vector": [names[i] for i in there], "links": got[there], "joined": [names[i] for i in root[there]]})

    built = leaves.groupBy("node").applyInPandas(build, "node string, vector binary, v binary, n bigint, way array<int>")
    built = spool(built, "leaf-trees")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))
    )
    asked = units.select("a", "b", F.inline(sides))
    return asked.join(built, "node").groupBy("a", "b").applyInPandas(search, "vector binary, links bigint, joined binary")


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, block: int = 2048, fan_out: int = 64, sample: int = 512,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row: links are pairs of one label with ``cosine`` or more.

    Vectors that are null, zero or empty, hold null or non-finite components, or whose label is null, link with nothing
    and are components of their own. Shorter vectors are filled up with zeros. component_id is the smallest id that links
    reach, null ids being reached but not named, and null only where all ids are; kept says that it is the row's own.
    Rows count one by one: rows of one id may link with each other, and each is returned. Other columns are left out,
    whatever their names; an empty table gives an empty result.

    Vectors equal in direction and label are one, with a count. A pair of nodes that lies within reach as a whole counts
    at once, so a crowd of near copies is no set of pairs; no pair is lost, as the bounds hold for all vectors of a node.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine lies over 0 and is 1 at most")
    reach = float(chord(np.array(cosine)))
    named = unit_vectors(vectors, id_col, label_col, vector_col)
    key = F.when(F.col("v").isNotNull(), F.unhex(F.md5(F.concat(F.encode(F.md5(F.encode("label", "utf-8")), "utf-8"), F.col("v")))))
    rows = spool(named.withColumn("vector", key), "unit-vectors")
    label = F.md5(F.encode("label", "utf-8"))
    distinct = rows.where("vector IS NOT NULL").groupBy("vector", label.alias("node"), "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    distinct = spool(distinct, "distinct-vectors")
    leaves, nodes = grown_tree(distinct.select("node", "vector", "v", "n"), block, fan_out, sample)
    units, whole = node_pairs(distinct.select("node").distinct(), nodes, reach)
    found = spool(leaf_links(leaves, units, cosine), "leaf-links")

    # what nodes link with as wholes goes to the leaves below, and there joins each vector with the uppermost one's first
    other = F.col("a") != F.col("b")
    gains = whole.select(F.col("a").alias("top"), F.col("weight_b").alias("got"), F.col("rep_a").alias("rep")).unionByName(
        whole.where(other).select(F.col("b").alias("top"), F.col("weight_a").alias("got"), F.col("rep_b").alias("rep"))
    )
    gains = gains.groupBy("top").agg(F.sum("got").alias("got"), F.min("rep").alias("rep"))
    steps = F.split("node", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "."))
    above = leaves.select("node").distinct().select("node", F.explode(prefixes).alias("top"))
    gained = above.join(gains, "top").groupBy("node").agg(F.sum("got").alias("links"), F.min_by("rep", F.length("top")).alias("joined"))
    in_whole = spool(leaves.select("node", "vector").join(gained, "node").select("vector", "links", "joined"), "whole-links")

    every = found.unionByName(in_whole)
    totals = every.groupBy("vector").agg(F.sum("links").alias("links"))
    edges = every.select(F.col("vector").alias("a"), F.col("joined").alias("b")).unionByName(whole.where(other).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    roots = spool(components(edges.where("a <> b")).withColumnRenamed("node", "vector"), "vector-roots")
    marked = distinct.select("vector", "n", "least").join(totals, "vector").join(roots, "vector", "left").withColumn("root", F.coalesce("root", "vector"))
    marked = spool(marked, "marked-vectors")
    ids = spool(marked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("of_root")), "components")
    final = spool(join_spread(marked, ids, ["root"], "of_root", ["vector"]).select("vector", "n", "links", "component"), "final-vectors")
    out = join_spread(rows.select("vec_id", "vector"), final, ["vector"], "n", ["vec_id"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
