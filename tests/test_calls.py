"""Batched calls of a model: no row lost or doubled, one bad text costs no other its vector."""

import pickle

import pytest
from pyspark.sql import functions as F

from millrace.operators.calls import Caller, OpenCircuitError, TemporaryError, with_vectors


def _model():
    def model(texts):
        assert 0 < len(texts) <= 32
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t)), float(len(texts))] for t in texts]

    return model


def test_rows_and_errors(spark):
    rows = [(i, None if i % 50 == 7 else "bad" if i % 90 == 11 else "x" * (i % 17), "old", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string, error string, batch int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # borders that 32 does not divide
    try:
        got = {r.id: r for r in with_vectors(df, _model()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1000
    for i, text, *_ in rows:
        if text is None or text == "bad":
            assert got[i].vector is None and got[i].error == ("no text" if text is None else "bad text")
        else:
            assert got[i].vector[0] == len(text) and got[i].error is None and got[i].batch == i
    full = sum(r.vector is not None and r.vector[1] > 1 for r in got.values())
    assert full > 500  # most batches went through whole
    assert with_vectors(df.where("false"), _model()).count() == 0
    assert with_vectors(df, _model(), tasks=2).rdd.getNumPartitions() == 2
    assert with_vectors(df.select("id", F.lit(None).cast("string").alias("text")), _model()).where("error <> 'no text'").count() == 0


def test_refusals_that_pass_are_tried_again():
    calls, waits = [], []

    def model(texts):
        calls.append(list(texts))
        if len(calls) < 3:
            raise TemporaryError("busy", after=7 if len(calls) == 1 else None)
        return [[0.0] for _ in texts]

    assert list(Caller(model, 3, 1.0, None, waits.append).vectors(["a", "b"])) == [([0.0], None)] * 2
    assert calls == [["a", "b"]] * 3 and 7 <= waits[0] <= 8.75 and 2 <= waits[1] <= 2.5
    again = pickle.loads(pickle.dumps(TemporaryError("busy", 3.0)))
    assert again.after == 3.0 and str(again) == "busy"


def test_a_breaker_ends_the_calls():
    calls = []

    def model(texts):
        calls.append(1)
        raise TemporaryError("down")

    caller = Caller(model, 0, 0.0, 3, lambda s: None)
    assert [e for _, e in caller.vectors(list("abcdef"))] == ["down", "down", *["circuit open"] * 4]
    assert len(calls) == 3
    with pytest.raises(OpenCircuitError):
        caller.call(["g"])


def test_a_model_that_gives_too_few_vectors():
    caller = Caller(lambda texts: [[1.0]], 0, 0.0, None, lambda s: None)
    assert list(caller.vectors(["a", "b"])) == [([1.0], None)] * 2  # text by text it gives one for one
    assert next(Caller(lambda texts: [], 0, 0.0, None, lambda s: None).vectors(["a"])) == (None, "0 vectors for 1 texts")
