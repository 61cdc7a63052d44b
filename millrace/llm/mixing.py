"""Mixing sources to target weights: hash-random order in each source, prefix sums, and an exact cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, running_before, spool


#: Up to so many sources their cuts are broadcast, a few MB; beyond that Spark joins by source and splits hot ones.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds target to rows of (source, source_size): one row for each source, which a mixture lists by name.

    Sources by code point, null last, weigh ``weights``, repeating. They share ``share`` times all sizes; none gets
    more than ``most`` times its own size, and what it leaves is shared by weight among the others.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everyone = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)
    ).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = weighed.withColumn(
        "budget_left",
        F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
    ).withColumn(
        "weight_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    capped = left.withColumn("is_capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("budget_left"))
    open_ = ~F.col("is_capped")
    level = F.max(F.when(open_, F.col("budget_left"))).over(everyone) / F.max(F.when(open_, F.col("weight_left"))).over(
        everyone
    )
    return capped.withColumn(
        "target", F.when(F.col("is_capped"), F.col("cap")).otherwise(level * F.col("weight"))
    ).select("source", "source_size", "target")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "",
    whole: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, key, epochs and taken (words) of each row of ``docs``.

    A source is taken whole ``epochs`` times, then in the order of its documents' hash keys up to its target. The
    document at the cut gives only the words that are still wanted; with ``whole`` it is taken if at least half of
    it is. A null text has size 0, a null source is a source of its own, a null id hashes like the empty one. Rows
    that repeat count one by one. Other columns are left out; an empty table gives an empty one. The text is read
    once and not shuffled; keys are uniform, so their first digits split every source into even ranges.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, 3))
    sized = spool(sized, "sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = targets.withColumnRenamed("source", "of_source")
    placed = running_before(sized, ["source"], "bucket", ["key", "doc_id", "size"], F.col("size"), "before")
    wanted = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    room = F.col("wanted") - F.col("epochs") * F.col("source_size") - F.col("before")
    extra = (
        F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        if whole
        else F.greatest(F.lit(0), F.least(F.col("size"), room))
    )
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("wanted", wanted)
        .withColumn("epochs", epochs)
        .withColumn("extra", F.when(room > 0, extra).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
        .select("doc_id", "source", "size", "source_size", "target", "key", "epochs", "extra", "taken")
    )


def mix_documents(docs: DataFrame, seed: str = "", id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself: ``docs`` with each row as often as whole documents of its source are taken.

    The plan comes down to one row for each source (its epochs and its last key), so the documents are neither
    sorted nor moved. Rows at the last key, as rows of one id are, are all taken. Columns are those of ``docs``,
    whatever their names; a null source is a source of its own, and null texts and ids are taken like others. An empty
    table gives an empty one.
    """
    plan = spool(mix_plan(docs, seed=seed, whole=True, id_col=id_col, source_col=source_col, **how), "mix-plan")
    cuts = plan.groupBy(F.col("source").alias("of")).agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("extra") > 0, F.col("key"))).alias("last"))
    cuts = spool(cuts, "cuts")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    field = F.col("doc").getField
    key = F.md5(F.concat(F.lit(seed), F.coalesce(field(id_col).cast("string"), F.lit(""))))
    copies = F.col("epochs") + F.when(key <= F.col("last"), 1).otherwise(0)
    return (
        whole.join(cuts, field(source_col).eqNullSafe(F.col("of")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
        .where("copy > 0")
        .select(*(field(c).alias(c) for c in docs.columns))
    )
