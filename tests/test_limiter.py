import datetime

import pytest

from millrace.plans import registry
from millrace.sources.tables import table
from millrace.streaming.limiter import limit, limit_stream

SF = "/root/testdata/sf0.001"


def brute_force(rows, hits, seconds):
    out, accepted = {}, []
    for ts, event, user in sorted(r for r in rows if None not in r):
        recent = [t for t, u in accepted if u == user and ts - t < datetime.timedelta(seconds=seconds)]
        out[event] = len(recent) < hits
        if out[event]:
            accepted.append((ts, user))
    return out


@pytest.mark.parametrize(("hits", "seconds"), [(1, 3_000_000), (2, 500_000), (10, 300)])
def test_limit(spark, hits, seconds):
    events = table(spark, SF, "events")
    rows = [(r.ts, r.event_id, r.user_id) for r in events.collect()]
    got = {r.event_id: r.accepted for r in limit(events, hits, seconds).collect()}
    assert got == brute_force(rows, hits, seconds)


def test_nulls_ties_and_empty(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at, 1, 1), (at, 2, 1), (at, 3, 2), (None, 4, 1), (at, 5, None), (at + datetime.timedelta(seconds=10), 6, 1)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, event_id long, user_id long")
    assert {r.event_id: r.accepted for r in limit(events, 1, 10).collect()} == {1: True, 2: False, 3: True, 6: True}
    assert limit(events.where("false")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = table(spark, SF, "events").orderBy("ts", "event_id")
    rows = events.collect()
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        limit_stream(stream, 2, 500_000).writeStream.format("memory").queryName("limited").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(100)
    got = {r.event_id: r.accepted for r in spark.table("limited").collect()}
    assert got == brute_force([(r.ts, r.event_id, r.user_id) for r in rows], 2, 500_000)


def test_registered(spark):
    assert registry.queries()["rate_limit_exact"](spark, SF).count() > 0
