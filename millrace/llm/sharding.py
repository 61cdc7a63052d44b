"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import running_before, spool

#: region, rack, shard, weight
Leaf = tuple[int, int, int, float]


def topology(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """``shards`` leaves of weight 1: regions of ``racks`` racks of ``per_rack`` shards, filled in order.

    The last region may be open; a shard that begins a new region takes rows only into itself.
    """
    per_region = racks * per_rack
    return [(s // per_region, s % per_region // per_rack, s, 1.0) for s in range(shards)]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    """-ln(u) / weight: the child with the least draw wins in proportion to its weight, and a child whose weight
    grows only gains keys."""
    digest = F.md5(F.concat(key, F.lit(f"/{level}/{node}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(node).alias("node"))


def _choose(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*(_draw(key, level, n, w) for n, w in sorted(weights.items()))))["node"]


def place(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of ``key``. Weights are positive; a node's is the sum of its leaves'."""
    if not tree or any(w <= 0 for *_, w in tree):
        raise ValueError("a tree needs leaves of positive weight")
    sums: dict[str, dict] = {"region": {}, "rack": {}, "shard": {}}
    for region, rack, shard, weight in tree:
        for level, at, node in (("region", (), region), ("rack", (region,), rack), ("shard", (region, rack), shard)):
            level_sums = sums[level].setdefault(at, {})
            level_sums[node] = level_sums.get(node, 0.0) + weight

    def descend(level: str, at: tuple[int, ...]) -> Column:
        weights = sums[level][at]
        name = "/".join(map(str, (level, *at)))
        if level == "shard":
            return _choose(key, name, weights)
        below = "rack" if level == "region" else "shard"
        nodes = sorted(weights)
        if len(nodes) == 1:
            return descend(below, (*at, nodes[0]))
        drawn = _choose(key, name, weights)
        out = descend(below, (*at, nodes[-1]))
        for node in nodes[-2::-1]:
            out = F.when(drawn == node, descend(below, (*at, node))).otherwise(out)
        return out

    return descend("region", ())


def shard_documents(
    docs: DataFrame,
    tree: Sequence[Leaf],
    grown: Sequence[Leaf] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot and grown_shard of each row.

    The id and the tree decide; the text does not, so equal texts may part. Rows of one id stay together, a null id
    counts as the empty key. A null text has size 1 and the checksum of no bytes. Slots are gapless from 0 in each
    shard, in the order of a hash of the id; rows equal in all that is returned share their slots in any order.
    Other columns are left out; an empty table gives an empty one. The text is read once and not shuffled.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, tree).cast("int").alias("shard"),
        (place(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.md5(key).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, 3))
    placed = spool(placed, "placed")
    slots = running_before(placed, ["shard"], "bucket", ["key", "size", "text_crc32"], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long"), "grown_shard")
