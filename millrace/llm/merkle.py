"""A Merkle manifest of a dataset: a tree for each source, and one over the sources, built by lag and lead windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import parallelism, same, spool

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one window partition: a multiple of each fan-out, so that no run is cut.
CHUNK = 4096


def hashed(digests: Column) -> Column:
    """The SHA-256 digest of bytes' lowercase hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def leaf_digest(fields: list[Column]) -> Column:
    """The SHA-256 digest of the fields, each ``-`` if null, else its byte count, a colon and its value."""
    told = [F.coalesce(F.concat(F.octet_length(s), F.lit(":"), s), F.lit("-")) for s in (c.cast("string") for c in fields)]
    return F.unhex(F.sha2(F.concat(*told), 256))


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``place``, a row's number from 0 in its group by ``order``, and ``of``, how many the group has.

    Rows are dealt by ranges of group and order, so a group that holds most rows lies in many ranges; what a range
    has of a group is counted first, and only these counts are summed over the group.
    """
    parts = parallelism(df.sparkSession)
    ranged = spool(df.repartitionByRange(parts, group, *order).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "range").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    starts = counts.select(
        F.col(group).alias("group_"), F.col("range").alias("range_"), F.sum("rows").over(whole).alias("of"),
        (F.sum("rows").over(whole.orderBy("range")) - F.col("rows")).alias("start"),
    )
    joined = ranged.join(starts, same([F.col(group), F.col("range")], [F.col("group_"), F.col("range_")]))
    nth = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order))
    return joined.withColumn("place", F.col("start") + nth - 1).drop("range", "start", "group_", "range_")


def with_siblings(level: DataFrame, fan_out: int) -> DataFrame:
    """``level`` (group, place, of, digest) with ``left`` and ``right``, the bytes of the siblings on either side.

    A column of fixed offset for each of the ``fan_out`` - 1 rows before and after; the slot and the length of the run
    say which of them belong to it.
    """
    near = "OVER (PARTITION BY group, chunk ORDER BY place)"
    before = [f"IF(slot >= {k}, lag(digest, {k}) {near}, X'')" for k in range(fan_out - 1, 0, -1)]
    after = [f"IF(slot + {k} < length, lead(digest, {k}) {near}, X'')" for k in range(1, fan_out)]
    runs = level.select(
        "*", F.expr(f"place % {fan_out}").alias("slot"), F.expr(f"floor(place / {CHUNK - CHUNK % fan_out})").alias("chunk"),
        F.expr(f"least({fan_out}, of - (place - place % {fan_out}))").alias("length"),
    )
    return runs.select(*level.columns, F.expr(f"concat({', '.join(before)})").alias("left"), F.expr(f"concat({', '.join(after)})").alias("right"))


def tree_levels(leaves: DataFrame, fan_out: int) -> list[DataFrame]:
    """The levels of each group's tree from ``leaves`` (group, place, of, digest) up: nodes of groups that have one left
    end there. First children hash their run into the parent."""
    levels = [leaves]
    while (levels[-1].agg(F.max("of")).first()[0] or 0) > 1:
        firsts = with_siblings(levels[-1].where("of > 1"), fan_out).where(F.col("place") % fan_out == 0)
        up = firsts.select(
            "group", F.floor(F.col("place") / fan_out).alias("place"), F.ceil(F.col("of") / fan_out).alias("of"),
            hashed(F.concat("digest", "right")).alias("digest"),
        )
        levels.append(spool(up, "merkle-level"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """group, digest: the one node that is left of each group."""
    out = levels[0].where("of = 1")
    for level in levels[1:]:
        out = out.unionByName(level.where("of = 1"))
    return out.select("group", "digest")


def paths(levels: list[DataFrame], above: DataFrame, fan_out: int) -> DataFrame:
    """The leaves (group, place) with ``subroot``, ``root`` and ``path``, the (left, right) siblings of each level.

    ``above`` (group, subroot, root, path) says what lies above each group's top node. Paths are handed down from
    the top, so each level meets the next one, which is ``fan_out`` times smaller, and no group's rows meet in one task.
    """
    down = None
    for level in reversed(levels):
        ends = level.where("of = 1").select("group", "place").join(above, "group")
        if down is not None:
            own = with_siblings(level.where("of > 1"), fan_out).select("group", "place", F.floor(F.col("place") / fan_out).alias("parent"), F.struct("left", "right").alias("own"))
            upper = down.withColumnRenamed("place", "parent")
            joined = own.join(upper.hint("merge"), ["group", "parent"])
            ends = ends.unionByName(joined.select("group", "place", "subroot", "root", F.concat(F.array("own"), "path").alias("path")))
        down = spool(ends, "merkle-paths") if level is not levels[0] else ends
    return down


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, digest, lambda node, s: hashed(F.concat(s["left"], node, s["right"])))


def proof(path: Column) -> Column:
    """The siblings on the way, level by level, as bytes."""
    return F.aggregate(path, F.lit(b""), lambda out, s: F.concat(out, s["left"], s["right"]))


def manifest(
    docs: DataFrame, fan_out: int = 16, tampered: Column | None = None, id_col: str = "doc_id", source_col: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text",
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; digests as lowercase hex.

    A leaf is the digest of the row's ``fields``. Rows of a source stand by id, null first, then by leaf; null is a
    source of its own and the first. Rows for which the condition ``tampered`` on the id holds are checked with a text
    whose A-Z are lower-cased against the siblings of the untampered tree; a null condition does not hold, so a null id
    is never tampered with. Rows equal in all fields are leaves of their own, next to each other in any order. Empty texts
    count as such; other columns play no part, whatever their names. An empty table gives an empty result.

    Texts are read twice, once to find the ranges of the order; only ids and digests move. All hashing and both passes are columns of DataFrames.
    """
    if not 2 <= fan_out <= CHUNK:
        raise ValueError(f"a fan-out lies between 2 and {CHUNK}")
    is_tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    text = F.translate(text_col, UPPER, LOWER)
    group = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))  # null sorts first
    rows = docs.select(
        F.col(id_col).alias("doc_id"), group.alias("group"), leaf_digest([F.col(f"`{f}`") for f in fields]).alias("digest"),
        F.when(is_tampered, leaf_digest([text if f == text_col else F.col(f"`{f}`") for f in fields])).alias("other"),
        F.monotonically_increasing_id().alias("at"),
    )
    order = ["doc_id", "digest", "at"]  # equal rows part by where they stand, so that no key is too large for a range
    leaves = spool(placed(rows, "group", order).drop("at"), "merkle-leaves")
    levels = tree_levels(leaves.select("group", "place", "of", "digest"), fan_out)
    subroots = spool(tops(levels), "subroots")

    by_source = placed(subroots.select(F.lit("").alias("all"), F.col("group").alias("name"), "digest"), "all", ["name"])
    by_source = spool(by_source.withColumnRenamed("all", "group"), "sources")
    upper = tree_levels(by_source.select("group", "place", "of", "digest"), fan_out)
    root = tops(upper).select("group", F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    nothing = F.array().cast("array<struct<left: binary, right: binary>>")
    ways = paths(upper, root.withColumn("path", nothing), fan_out)
    above = ways.drop("subroot").join(by_source, ["group", "place"])
    above = spool(above.select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "root", "path"), "above-sources")

    found = leaves.join(paths(levels, above, fan_out).hint("merge"), ["group", "place"])
    text_of = lambda c: F.lower(F.hex(c))
    out = found.select(
        "doc_id", text_of("digest").alias("leaf"), text_of("subroot").alias("subroot"), text_of("root").alias("root"),
        F.sha2(text_of(proof(F.col("path"))), 256).alias("proof_sha256"),
        text_of(folded(F.coalesce("other", "digest"), F.col("path"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
