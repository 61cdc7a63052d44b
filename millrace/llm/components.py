"""Connected components of a link table, by rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_spread, spool


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node of ``links`` (a, b): root is the smallest node that can be reached.

    Alternates large-star and small-star rounds: each node tells its larger (then smaller) neighbours about the
    smallest one it knows. Both shrink the link table towards stars, in about log rounds; minima per node are
    aggregated before they move, and the links of a node that many have are dealt over many tasks. An empty link
    table gives an empty one.
    """
    now = spool(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = spool(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
        large = join_spread(both, least, ["a"], "n", ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = spool(large.distinct(), "large-star")
        least = spool(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = join_spread(large, least, ["a"], "n", ["b"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = spool(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        size = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == (size.n, size.h):
            break
        seen = (size.n, size.h)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
