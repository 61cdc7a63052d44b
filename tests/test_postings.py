"""The written postings index against a plain BM25 over all documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.postings import B, K1, PostingsIndex


def plain(docs, queries, k):
    words = {d: (t or "").split() for d, t in docs}
    mean = np.mean([len(w) for w in words.values()])
    out = []
    for q, terms in queries.items():
        scores = {}
        for t in terms:
            df = sum(t in w for w in words.values())
            for d, w in words.items():
                if tf := w.count(t):
                    part = np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
                    scores[d] = scores.get(d, 0) + part
        best = sorted(((-round(s, 6), d) for d, s in scores.items()))[:k]
        out += [(q, d, n + 1, pytest.approx(-s, abs=2e-6)) for n, (s, d) in enumerate(best)]
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    names = np.array([f"t{i}" for i in range(300)])
    p = 1 / np.arange(1, 301)
    docs = [(int(i) * 7 - 400, " ".join(rng.choice(names, rng.integers(1, 120), p=p / p.sum()))) for i in range(600)]
    docs += [(10**12, "t0 t299"), (10**12 + 1, "t0 t299"), (-5000, None), (-5001, ""), (-5002, "t250 " * 4000)]
    queries = {q: sorted(set(rng.choice(names, rng.integers(1, 9)).tolist())) for q in range(25)} | {100: ["t0"], 101: ["nowhere"], 102: ["t0", "t299", "nowhere"]}
    return docs, queries


def found(index, spark, queries, k):
    asked = spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "query_id long, term string")
    rows = sorted(((r.query_id, r.doc_id, r["rank"], r.score) for r in index.search(asked, k).collect()), key=lambda r: (r[0], r[2]))
    return rows, index.read_share(asked, k)


def test_index_gives_the_best_and_skips_the_rest(spark, tmp_path, texts):
    docs, queries = texts
    index = PostingsIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/i", parts=4, size=16)
    rows, share = found(index, spark, queries, 5)
    assert rows == plain(docs, queries, 5)
    assert 0 < share < 1  # the bounds rule some ranges out
    again = PostingsIndex(spark, index.path, 4)  # another reader of the same folder
    assert found(again, spark, queries, 5)[0] == rows


def test_additions_touch_no_block(spark, tmp_path, texts):
    docs, queries = texts
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = PostingsIndex.build(df.where("doc_id % 3 <> 0"), f"file://{tmp_path}/i", parts=4, size=16)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "i" / "postings").rglob("*.parquet")}
    index.add(df.where("doc_id % 3 = 0"))
    index.add(df.where("false"))
    index.add(spark.createDataFrame([(5 * 10**12, "quite new words")], "doc_id long, text string"))
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    every = [*docs, (5 * 10**12, "quite new words")]
    asked = queries | {200: ["quite", "t1"]}
    assert found(index, spark, asked, 7)[0] == plain(every, asked, 7)
    new = spark.read.parquet(f"file://{tmp_path}/i/postings").where(F.col("first") == 5 * 10**12)
    assert {r.term for r in new.collect()} == {"quite", "new", "words"}


def test_an_index_without_words(spark, tmp_path, texts):
    none = spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string")
    for i, docs in enumerate((none, none.where("false"))):
        index = PostingsIndex.build(docs, f"file://{tmp_path}/{i}")
        assert found(index, spark, texts[1], 3) == ([], 0.0)
    index.add(spark.createDataFrame([(3, "t0")], "doc_id long, text string"))
    assert [r[:3] for r in found(index, spark, {1: ["t0"]}, 3)[0]] == [(1, 3, 1)]
