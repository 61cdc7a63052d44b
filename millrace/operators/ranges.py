"""Running sums over groups that no task need hold whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, groups: list[str], bucket: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same group that come earlier.

    ``bucket`` splits each group into ranges of its order, so no task holds a whole group: totals per range are
    summed over the ranges, then rows are summed within theirs. ``df`` is read twice; pass a written table.
    """
    keys = [*groups, bucket]
    totals = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(k).alias(f"_t_{k}") for k in keys), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(totals[f"_t_{k}"])
    return df.join(totals, same).withColumn(out, F.col("_start") + F.sum(amount).over(inside) - amount).drop("_start", *(f"_t_{k}" for k in keys))
