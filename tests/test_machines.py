"""Machines over tables and streams: equal rows, restarts, late and repeated events."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.sources.tables import table
from millrace.streaming import machines
from millrace.streaming.memory import SECOND, SummaryCursor, Throttle, token_estimate, wait

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def _stub():
    def summarise(summary, turns, failures):
        """Fails by what it gets: where the last turn's number is divisible by 4, up to that part of it in a row."""
        if turns[-1][0] % 4 == 0 and failures < turns[-1][0] % 7:
            raise RuntimeError("refused")
        return f"{summary or ''}|{turns[0][0]}-{turns[-1][0]}:{sum(len(t) for *_, t in turns)}"

    return summarise  # made here, so that it travels to the workers by value


stub = _stub()


def plain_cursor(turns, window, trigger, until):
    """(at, outcome, from, to, n, failures) of turns (us, turn, text), written out as the rules say, moment by moment."""
    out, held, summary, failures, failed_at, seen = [], [], None, 0, None, None
    pending = sorted(turns)

    def attempt(us):
        nonlocal held, summary, failures, failed_at
        while True:
            used, keep = 0, []
            for t in reversed(held):
                if used + token_estimate(t[1]) > window:
                    break
                used += token_estimate(t[1])
                keep.append(t)
            outside = [t for t in held if t not in keep] if keep else []
            if not outside or sum(len(t[1]) for t in outside) / 1.5 < trigger:
                return
            try:
                summary = stub(summary, [(n, "r", x) for n, x in outside], failures)
            except RuntimeError:
                failures, failed_at = failures + 1, us
                out.append((us, "failed", outside[0][0], outside[-1][0], len(outside), failures, None))
                return
            failures, failed_at = 0, None
            held = keep[::-1]
            out.append((us, "summarised", outside[0][0], outside[-1][0], len(outside), 0, summary))

    while pending or failed_at is not None:
        retry = None if failed_at is None else failed_at + min(900, 60 * 2 ** (failures - 1)) * SECOND
        if retry is not None and (not pending or retry <= pending[0][0]):
            if retry > until:
                break
            rows = len(out)
            attempt(retry)
            failed_at = failed_at if len(out) > rows else None
            continue
        us, turn, text = pending.pop(0)
        if seen is not None and turn <= seen:
            continue
        seen = turn
        held.append((turn, text or ""))
        if failed_at is None:
            attempt(us)
    return out


def conversations():
    """(conv_id, turn, role, text, ts) with turns of many lengths, one too long for the window, repeats and a null."""
    rows = []
    for conv in range(6):
        for turn in range(40):
            n = (conv * 37 + turn * 53) % 90 + (400 if turn == 17 and conv == 2 else 0)
            text = None if (conv + turn) % 19 == 0 else "x" * n
            rows.append((conv, turn, "user", text, T0 + datetime.timedelta(seconds=turn * (25 if conv % 2 else 140) + conv)))
            if turn % 13 == 5:
                rows.append((conv, turn, "user", text, T0 + datetime.timedelta(seconds=turn * (25 if conv % 2 else 140) + conv + 1)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, ts timestamp"


def micros(ts):
    return int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * SECOND)


def result(df):
    return sorted((r.conv_id, r.at, r.outcome, r.from_turn, r.to_turn, r.messages, r.failures, r.summary) for r in df.collect())


def want(rows, until):
    out = []
    for conv in {r[0] for r in rows}:
        out += [(conv, *r) for r in plain_cursor([(micros(r[4]), r[1], r[3]) for r in rows if r[0] == conv], 60, 80, until)]
    return sorted(out)


def test_waits_double_up_to_fifteen_minutes():
    assert [wait(n) // SECOND for n in (1, 2, 3, 4, 5, 9, 100)] == [60, 120, 240, 480, 900, 900, 900]


def test_summary_cursor_over_a_table(spark):
    rows = conversations()
    until = micros(T0) + 50_000 * SECOND
    cursor = SummaryCursor(stub, 60, 80)
    got = result(machines.over_table(spark.createDataFrame(rows, SCHEMA), "conv_id", cursor, order="turn", until=until))
    expected = want(rows, until)
    assert {r[2] for r in expected} == {"failed", "summarised"} and max(r[6] for r in expected) > 1
    assert got == expected


def test_summary_cursor_over_a_stream_that_is_restarted(spark, tmp_path):
    """Turns come out of order, in several runs that each begin from the checkpoint; the rows are the table's."""
    rows = conversations()
    end = T0 + datetime.timedelta(days=1)
    batches = [rows[i::4] for i in range(4)]  # a conversation's turns are spread over all batches
    order = sorted(range(len(rows)), key=lambda i: (rows[i][4] + datetime.timedelta(seconds=(i * 7919) % 600)))
    batches = [[rows[i] for i in order[k * len(order) // 4 : (k + 1) * len(order) // 4]] for k in range(4)]
    batches.append([(99, 0, "user", "late mover", end)])
    schema = spark.createDataFrame([], SCHEMA).schema
    source = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = machines.over_stream(stream, "conv_id", SummaryCursor(stub, 60, 80), "20 minutes", order="turn")
        machines.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "state"), spark)
    until = micros(end) - 1200 * SECOND
    assert result(spark.read.parquet(str(tmp_path / "out"))) == want(rows, until)


def test_cursors_of_an_earlier_job_are_where_it_starts(spark, tmp_path):
    rows = [r for r in conversations() if r[0] in (1, 3)]
    begun = spark.createDataFrame([(1, "old", 11, 11, 0, None, [], [], [])], f"conv_id long, {SummaryCursor.state}")
    table_rows = result(machines.over_table(spark.createDataFrame(rows, SCHEMA), "conv_id", SummaryCursor(stub, 60, 80), order="turn", until=micros(T0) + 80_000 * SECOND, initial=begun))
    assert min(r[3] for r in table_rows if r[0] == 1) == 12 and all(r[7].startswith("old|") for r in table_rows if r[0] == 1 and r[7])
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame([*rows, (99, 0, "user", "", T0 + datetime.timedelta(seconds=81_200))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = machines.over_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "conv_id", SummaryCursor(stub, 60, 80), "20 minutes", order="turn", initial=begun)
    machines.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "state"), spark)
    assert result(spark.read.parquet(str(tmp_path / "out"))) == table_rows


@pytest.mark.parametrize("idle", [None, 20_000 * SECOND])
def test_throttle_over_table_and_stream(spark, tmp_path, idle):
    bucket = F.floor(F.col("value") / 5).cast("long")
    events = table(spark, SF, "events").withColumns({"bucket": bucket, "ends": F.col("event_type").isin("purchase", "error"), "ts": F.col("ts").cast("timestamp")})
    got = sorted((r.event_id, r.user_id, r.bucket) for r in machines.over_table(events, "user_id", Throttle(), idle=idle).collect())
    last, expected = {}, []
    for r in sorted(events.where("user_id is not null and ts is not null").collect(), key=lambda r: (r.ts, r.event_id)):
        at, before = last.get(r.user_id, (None, None))
        if idle and at and (r.ts - at).total_seconds() * SECOND > idle:
            before = None
        if before is None or before != r.bucket or r.ends:
            expected.append((r.event_id, r.user_id, r.bucket))
        last[r.user_id] = (r.ts, r.bucket)
    assert got == sorted(expected)
    end = events.agg(F.max("ts")).first()[0] + datetime.timedelta(days=400)
    mover = events.limit(1).withColumns({"ts": F.lit(end), "user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long")})
    path = str(tmp_path / "in")
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):  # the second file's events lie among the first's
        events.where(part).coalesce(1).write.mode("append").parquet(path)
    mover.select(events.columns).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    machines.run_to_table(machines.over_stream(stream, "user_id", Throttle(), "399 days", idle=idle), str(tmp_path / "out"), str(tmp_path / "state"), spark)
    streamed = sorted((r.event_id, r.user_id, r.bucket) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.user_id != -1)
    assert streamed == sorted(expected)


def test_late_and_odd_events(spark, tmp_path):
    """An event behind the watermark is dropped; null keys and times are left out; an empty table gives no rows."""
    schema = "event_id long, user_id long, bucket long, ends boolean, ts timestamp"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    files = [[(1, 1, 5, None, at(100)), (2, 1, 5, False, at(200)), (3, None, 1, True, at(5)), (4, 1, 1, True, None)], [(5, 1, 7, False, at(10)), (6, 1, None, False, at(1000))], [(7, 1, 7, True, at(1001)), (9, 2, 0, False, at(9000))]]
    path = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)
        machines.run_to_table(machines.over_stream(stream, "user_id", Throttle(), "30 seconds"), str(tmp_path / "out"), str(tmp_path / "state"), spark)
    assert sorted((r.event_id, r.bucket) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 5), (7, 7)]
    whole = spark.createDataFrame([r for f in files for r in f], schema)
    assert sorted((r.user_id, r.event_id, r.bucket) for r in machines.over_table(whole, "user_id", Throttle()).collect()) == [(1, 1, 5), (1, 5, 7), (1, 7, 7), (2, 9, 0)]
    assert machines.over_table(whole.where("false"), "user_id", Throttle()).count() == 0
