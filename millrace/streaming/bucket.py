"""A token bucket for each key: calls wait for a token, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.streaming.limiter import timed


def token_bucket(events: DataFrame, per_token_us: int, burst: int, range_us: int = 3_600_000_000) -> DataFrame:
    """event_id, user_id and waited (microseconds) of each event with a user and a time.

    A user's bucket starts with ``burst`` tokens and gains one every ``per_token_us``, never above ``burst``. With
    calls i = 1, 2 ... at times t, the bucket is full again at max over j <= i of t[j] + (i - j + 1) * per_token_us,
    so a running maximum says how long the next call waits. Maxima are taken within ranges of time and then over the
    ranges, so a user with very many events is split over tasks.
    """
    keys = ["user_id", "range"]
    rows = timed(events).withColumn("range", F.floor(F.col("us") / range_us))
    before = Window.partitionBy("user_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    starts = counts.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("us", "event_id")
    placed = rows.join(starts, keys).withColumn("i", F.col("start") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("level", F.col("us") - F.col("i") * per_token_us)
    tops = placed.groupBy(*keys).agg(F.max("level").alias("top"))
    tops = tops.select(*keys, F.max("top").over(before).alias("earlier"))
    here = F.max("level").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    full_at = F.greatest("earlier", here) + F.col("i") * per_token_us  # null for a user's first call
    waited = F.greatest(F.lit(0), F.coalesce(full_at - (burst - 1) * per_token_us - F.col("us"), F.lit(0)))
    return placed.join(tops, keys).select("event_id", "user_id", waited.cast("long").alias("waited"))
