"""Tables that change together: rows as a plain model of them, whole after a writer ends early, readers at their commit."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.sources.commits import ConflictError, Store
from millrace.sources.written import folder
from millrace.streaming.indexing import index_documents, index_stream


@pytest.fixture
def store(spark):
    return Store(spark, folder(spark, "test_store"), 4)


def held(snapshot, name):
    return sorted((tuple(r) for r in snapshot.read(name).collect()), key=repr)


def test_as_a_plain_table(spark, store):
    rng = random.Random(3)
    plain: list[tuple] = []
    for step in range(6):
        rows = [(rng.choice([None, *range(9)]), rng.randrange(9), f"{step}") for _ in range(rng.randrange(8))]
        if step % 3 < 2:
            df = spark.createDataFrame(rows, "a long, b long, text string")
            store.update(lambda c, df=df: c.put("t", df, ["a"]))
            plain = [r for r in plain if r[0] not in {x[0] for x in rows}] + rows
        else:
            ids = {rng.randrange(9), rng.randrange(9)}
            gone = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
            store.update(lambda c, gone=gone: c.delete("t", gone, ["a", "b"]))
            plain = [r for r in plain if r[0] not in ids and r[1] not in ids]
        assert held(store.latest(), "t") == sorted(plain, key=repr)
    assert store.latest().version == 6


def test_gone_without_new_rows(spark, store):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, text string")
    store.update(lambda c: c.put("t", rows, ["id"]))
    gone = spark.createDataFrame([(2,), (None,), (77,)], "id long")
    after = store.update(lambda c: c.put("t", rows.where("id = 1 and text = 'b'"), ["id"], gone))
    assert held(after, "t") == [(1, "a"), (1, "b"), (1, "b")]


def test_only_touched_buckets_are_written(spark, store):
    store.update(lambda c: c.put("t", spark.range(100).withColumn("x", F.lit(1)), ["id"]))
    before = store.latest().manifest["tables"]["t"]["folders"]
    after = store.update(lambda c: c.put("t", spark.range(1).withColumn("x", F.lit(2)), ["id"])).manifest["tables"]["t"]["folders"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert store.latest().read("t").where("x = 2").count() == 1 and store.latest().read("t").count() == 100


def test_a_writer_that_ends_early_changes_nothing(spark, store):
    first = spark.createDataFrame([(1, "old")], "id long, text string")
    store.update(lambda c: (c.put("documents", first, ["id"]), c.put("chunks", first, ["id"])))

    def stops(c):
        c.put("documents", first.withColumn("text", F.lit("new")), ["id"])
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.update(stops)
    again = Store(spark, store.root)
    assert again.buckets == 4 and again.latest().version == 1
    assert held(again.latest(), "documents") == held(again.latest(), "chunks") == [(1, "old")]
    assert again.vacuum() == 0  # all is young
    assert again.vacuum(age=-1) == 2 and held(again.latest(), "documents") == [(1, "old")]


def test_readers_stay_and_the_second_writer_goes_again(spark, store):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    store.update(lambda c: c.put("t", rows, ["id"]))
    reader, mine = store.latest(), store.change()
    mine.put("t", rows.withColumn("text", F.lit("mine")), ["id"])
    store.update(lambda c: c.put("t", rows.withColumn("text", F.lit("other")), ["id"]))
    with pytest.raises(ConflictError):
        mine.commit()
    assert held(reader, "t") == [(1, "a")] and held(store.latest(), "t") == [(1, "other")] == held(store.at(2), "t")
    lost = []

    def races(c):
        if not lost:
            lost.append(1)
            store.update(lambda other: other.put("u", rows, ["id"]))
        c.put("t", rows.withColumn("text", F.lit("mine")), ["id"])

    after = store.update(races)
    assert after.version == 4 and held(after, "t") == [(1, "mine")] and held(after, "u") == [(1, "a")]


def test_refused(spark, store):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    store.update(lambda c: c.put("t", rows, ["id"]))
    for bad, key in ((rows, ["text"]), (rows.drop("text"), ["id"]), (rows.withColumn("_bucket", F.lit(1)), ["id"])):
        with pytest.raises(ValueError):
            store.change().put("t", bad, key)
    with pytest.raises(KeyError):
        store.latest().read("none")
    assert store.update(lambda c: c.put("t", rows.limit(0), ["id"])).read("t").count() == 1


def lines(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("position", "text")).where("text <> ''")


def model():
    def vectors(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]

    return vectors


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, at int")


def states(snapshot):
    return {r.doc_id: (r.status, r.n_chunks, r.n_embedded) for r in snapshot.read("documents").collect()}


def texts(snapshot):
    out: dict = {}
    for r in snapshot.read("chunks").orderBy("doc_id", "position").collect():
        out.setdefault(r.doc_id, []).append(r.text)
        assert r.vector == [float(len(r.text))]
    return out


def test_statuses_and_what_is_kept(spark, store):
    def deliver(rows, number):
        return store.update(lambda c: index_documents(c, batch(spark, rows), "at", lines, model()), "job", number)

    first = deliver([(1, "a b a", 1), (1, "older", 0), (2, "", 1), (3, "bad", 1), (4, "x bad y", 1), (5, None, 1), (None, "q", 1)], 0)
    want = {1: ("indexed", 3, 3), 2: ("failed", 0, 0), 3: ("failed", 1, 0), 4: ("partial", 3, 2), 5: ("failed", 0, 0)}
    assert states(first) == want and texts(first) == {1: ["a", "b", "a"], 4: ["x", "y"]}
    second = deliver([(1, "a bad", 2), (3, "good", 2), (4, "x y z", 2)], 1)
    want |= {1: ("failed", 2, 1), 3: ("indexed", 1, 1), 4: ("indexed", 3, 3)}
    assert states(second) == want and texts(second) == {1: ["a", "b", "a"], 3: ["good"], 4: ["x", "y", "z"]}
    assert deliver([(1, "lost", 3)], 1).version == second.version  # a batch that comes twice
    third = deliver([(1, "a bad", 4), (3, "good", 4)], 2)  # a failed document is tried again, an indexed one is not
    assert states(third) == want and texts(third) == texts(second)
    last = deliver([(1, "b c", 5), (4, "", 5)], 3)
    assert states(last) == want | {1: ("indexed", 2, 2), 4: ("failed", 0, 0)} and texts(last)[1] == ["b", "c"] and texts(last)[4] == ["x", "y", "z"]


def test_a_stream_and_its_restart(spark, store):
    source, checkpoint = folder(spark, "index_source"), folder(spark, "index_checkpoint")
    schema = "doc_id long, text string, at int"

    def run(at):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        index_stream(stream, store, "job", at, "at", lines, model())
        return store.latest()

    batch(spark, [(1, "a b", 1), (2, "c", 1)]).coalesce(1).write.mode("append").parquet(source)
    first = run(checkpoint)
    assert texts(first) == {1: ["a", "b"], 2: ["c"]} and first.done("job") == 0
    assert run(folder(spark, "index_checkpoint")).version == first.version  # the checkpoint was lost, not the commit
    batch(spark, [(1, "a", 2)]).coalesce(1).write.mode("append").parquet(source)
    second = run(checkpoint)
    assert texts(second) == {1: ["a"], 2: ["c"]} and second.done("job") == 1
