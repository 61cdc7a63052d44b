import datetime

from pyspark.sql import functions as F

from millrace.sources.tables import table
from millrace.streaming.breaker import breaker, breaker_stream
from millrace.streaming.bucket import token_bucket

SF = "/root/testdata/sf0.001"


def failed():
    return F.col("event_type") == "error"


def plain_breaker(rows, failures, seconds):
    out, kept = {}, {}
    for ts, event, user, kind in sorted(rows):
        b = kept.setdefault(user, {"open": False, "count": 0, "last": None})
        probe = b["open"]
        if probe and (ts - b["last"]).total_seconds() < seconds:
            out[event] = (False, "open")
            continue
        if kind == "error":
            b["count"] += 1
            b["last"] = ts
            b["open"] = probe or b["count"] >= failures
        else:
            b["count"], b["open"] = 0, False
        out[event] = (True, "open" if b["open"] else "closed")
    return out


def test_breaker(spark):
    events = table(spark, SF, "events")
    rows = [(r.ts, r.event_id, r.user_id, r.event_type) for r in events.collect()]
    want = plain_breaker(rows, 2, 500_000)
    assert {ok for ok, _ in want.values()} == {True, False}
    assert {r.event_id: (r.allowed, r.state) for r in breaker(events, failed(), 2, 500_000).collect()} == want


def test_breaker_stream(spark, tmp_path):
    events = table(spark, SF, "events").orderBy("ts", "event_id")
    rows = events.collect()
    for part in (rows[:400], rows[400:]):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        breaker_stream(stream, failed(), 2, 500_000).writeStream.format("memory").queryName("broken").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(100)
    got = {r.event_id: (r.allowed, r.state) for r in spark.table("broken").collect()}
    assert got == plain_breaker([(r.ts, r.event_id, r.user_id, r.event_type) for r in rows], 2, 500_000)


def test_bucket_against_plain_tokens(spark):
    """Waiting calls take tokens in turn, as a bucket that is refilled over time gives them."""
    events = table(spark, SF, "events")
    want, state = {}, {}
    start = datetime.datetime(2024, 1, 1)
    per, burst = 40_000, 2  # seconds for a token
    for ts, event, user in sorted((r.ts, r.event_id, r.user_id) for r in events.collect()):
        t = (ts - start).total_seconds()
        tokens, last = state.get(user, (float(burst), t))
        now = max(t, last)
        tokens = min(burst, tokens + (now - last) / per)
        if tokens < 1 - 1e-9:
            now, tokens = now + (1 - tokens) * per, 1.0
        state[user] = (tokens - 1, now)
        want[event] = now - t
    got = {r.event_id: r.waited / 1e6 for r in token_bucket(events, per * 1_000_000, burst).collect()}
    assert got.keys() == want.keys() and max(want.values()) > per
    assert all(abs(got[k] - want[k]) < 0.01 for k in want)


def test_empty_and_null(spark):
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(at, 1, 1, None), (None, 2, 1, "error"), (at, 3, None, "error")], "ts timestamp_ntz, event_id long, user_id long, event_type string")
    assert [tuple(r) for r in breaker(events, failed()).collect()] == [(1, 1, True, "closed")]
    assert [tuple(r) for r in token_bucket(events, 1000, 1).collect()] == [(1, 1, 0)]
    assert breaker(events.where("false"), failed()).count() == token_bucket(events.where("false"), 1000, 1).count() == 0
