"""Blocked search, relations and rankings against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.numbers import percent, ratio
from millrace.functions.text import STOP_WORDS, THREE_TOKENS, TOKEN
from millrace.operators import relations, retrieval, search
from millrace.plans import queries as plans


def test_blocks_hold_each_query_once(spark):
    queries = spark.range(50).withColumnRenamed("id", "query_id")
    parts = list(search.blocks(queries, 7))
    assert sorted(i for p in parts for i in p["query_id"]) == list(range(50)) and len(parts) == 8
    assert list(search.blocks(queries.where("false"))) == []


@pytest.mark.parametrize("group", [None, "g"])
def test_vector_top(spark, group):
    rng = np.random.default_rng(0)
    v = {i: rng.integers(-3, 4, 4).astype(float) for i in range(300)}  # many ties, and vectors without length
    rows = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in v.items()], "vec_id long, v array<double>, g int").repartition(5)
    queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    got = sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in retrieval.vector_top(rows, queries, 4, group=group).collect())
    want = []
    for q in range(0, 300, 10):
        for g in range(3 if group else 1):
            cosine = {i: float(np.round(v[q] @ x / n, 6)) if (n := np.linalg.norm(v[q]) * np.linalg.norm(x)) else 0.0 for i, x in v.items() if i != q and (not group or i % 3 == g)}
            want += [(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(cosine.items(), key=lambda p: (-p[1], p[0]))[:4])]
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])


def test_searches_without_queries_or_hits(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "query_id long, text string")
    some = spark.createDataFrame([(7, "two three"), (8, "!"), (9, None)], "query_id long, text string")
    for find in (retrieval.bm25, retrieval.bow_cosine):
        assert find(docs, none, 3).count() == 0
        assert [(r.query_id, r.doc_id) for r in find(docs, some, 3).collect()] == [(7, 1)]
    assert retrieval.containing(docs, some).count() == 0 and retrieval.containing(docs, none).count() == 0


def test_fallback_reaches_queries_without_a_hit(spark):
    schema = "query_id long, doc_id long, score double, rank int"
    found = spark.createDataFrame([(1, 10, 1.0, 1)], schema)
    relaxed = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.5, 2), (2, 12, 0.7, 1)], schema)
    got = {(r.query_id, r.doc_id) for r in retrieval.with_fallback(found, relaxed, 2).collect()}
    assert got == {(1, 10), (1, 11), (2, 12)}


def test_relations_count_all_entities(spark):
    rows = [(d, e, f) for d, es in {0: {"a": 2, "b": 3}, 1: {"a": 2, "b": 3}, 2: {"a": 2, "c": 5}, 3: {"z": 2}, 20: {"a": 9}}.items() for e, f in es.items()]
    ents = spark.createDataFrame(rows, "doc_id long, entity string, freq long")
    got = {(r.source, r.target): (r.cosine, r.jaccard, r.relation) for r in relations.pair_relations(ents, F.col("doc_id") % 20 == 0).collect()}
    df = {"a": 4, "b": 2, "c": 1, "z": 1}
    w = {d: {e: f * (np.log(6 / (1 + df[e])) + 1) for dd, e, f in rows if dd == d} for d in (0, 1, 2, 3, 20)}
    want = {}
    for s, t in ((0, 1), (0, 2), (0, 3), (0, 20), (20, 1), (20, 2), (20, 3)):
        both = set(w[s]) & set(w[t])
        cosine = sum(w[s][e] * w[t][e] for e in both) / np.sqrt(sum(x * x for x in w[s].values()) * sum(x * x for x in w[t].values()))
        jaccard = len(both) / len(set(w[s]) | set(w[t]))
        if cosine >= 0.3:
            want[s, t] = (round(cosine, 6), round(jaccard, 6), "duplicate" if jaccard >= 0.5 else "complementary")
    assert got == want


def test_mmr_penalty_spreads_groups(spark):
    hits = [(1, i, 1.0 - i / 100, [1.0, float(i)], "a" if i < 5 else "b") for i in range(8)]
    df = spark.createDataFrame(hits, "query_id long, vec_id long, score double, v array<double>, doc string")
    picks = lambda **how: [r.vec_id for r in retrieval.mmr(df, keep=4, balance=1.0, **how).orderBy("pick").collect()]
    assert picks() == [0, 1, 2, 3]
    assert picks(group="doc", most=2, penalty=2.0) == [0, 1, 5, 6]


def test_filter_names_missing_columns():
    with pytest.raises(ValueError, match="years"):
        retrieval.RetrievalFilter(years=frozenset({2020})).predicate()


def test_rounding(spark):
    df = spark.createDataFrame([(1, 8), (5, 8), (2, 3), (0, 7), (1, 0), (1005, 1000)], "a long, b long")
    got = [(r.r, r.p) for r in df.select(ratio(F.col("a"), F.col("b")).alias("r"), percent(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [(0.13, 12.5), (0.63, 62.5), (0.67, 66.67), (0.0, 0.0), (None, None), (1.01, 100.5)]


@pytest.mark.parametrize("stop", [True, False])
def test_terms_are_scored_where_they_are_counted(spark, stop, monkeypatch):
    """No posting is written or shuffled; ties, null texts and stop words as a plain version has them."""
    monkeypatch.setattr(retrieval.PostingsIndex, "build", lambda *a, **b: pytest.fail("an index was written"))
    rng = np.random.default_rng(3)
    words = ["the", "and", "red", "blue", "oak", "elm", "sea"]
    texts = {i: " ".join(rng.choice(words, rng.integers(1, 9))) for i in range(300)} | {300: None, 301: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked = {1: "the red oak", 2: "sea and elm", 3: "nothing here", 4: "blue"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    split = {i: t.split() for i, t in texts.items() if t is not None}
    mean = np.mean([len(w) for w in split.values()])
    want = {}
    for q, text in asked.items():
        scores = {}
        for term in set(text.split()) - set(STOP_WORDS if stop else []):
            df = sum(term in w for w in split.values())
            for i, w in split.items():
                if tf := w.count(term):
                    scores[i] = scores.get(i, 0) + np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:7]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25(docs, queries, 7, stop=stop).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert np.allclose([got[k][1] for k in want], [v[1] for v in want.values()], atol=2e-6)


def test_lines_of_three_tokens(spark):
    lines = ["a b c", "abc", "a b", "ab-c_d!", "中文字", "中 a", "", "... a,b;c", "é ü1 2", "x" * 5000, "\ufffd\u9ffd a b c", "a\u9ffd b", "aİb c"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select(F.lower("x").rlike(THREE_TOKENS).alias("a"), (F.regexp_count(F.lower("x"), F.lit(TOKEN)) >= 3).alias("b"))
    assert all(r.a == r.b for r in df.collect())


def test_questions_know_their_documents(spark):
    asked = spark.createDataFrame([(d, p, f"word{d} line{p} same") for d in (-5, -1, 0, 7, 2**60) for p in range(3)], "doc_id long, position int, text string")
    queries = spark.createDataFrame([(1, "same"), (2, "word-5 line1 same")], "query_id long, text string")
    got = {(r.query_id, r.doc_id) for r in retrieval.question_channel(asked, queries, 5).collect()}
    assert {d for q, d in got if q == 1} == {-5, -1, 0, 7, 2**60}


@pytest.mark.parametrize(("name", "times"), [("eval_transitions", 1), ("evidence_gate", 1), ("rerank_reorder", 1)])
def test_a_search_is_done_once(spark, name, times, monkeypatch):
    """What two parts of a plan read is searched once: plans beyond the written hits read no document."""
    found, channels = [], retrieval.channels
    monkeypatch.setattr(retrieval, "channels", lambda *a, **b: found.append(1) or channels(*a, **b))
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(found) == times and "lang#" not in plan and "n_chars#" not in plan
    assert "MapInArrow" not in plan


def _random_entities(spark):
    rng = np.random.default_rng(5)
    rows = [(d, f"e{e}", int(rng.integers(2, 9))) for d in range(120) for e in sorted({int(x) for x in rng.zipf(1.6, 12) if x < 60})]
    return rows, spark.createDataFrame(rows, "doc_id long, entity string, freq long")


def test_relations_of_some_documents_are_those_of_all(spark, monkeypatch):
    """Of the documents that are asked for alone, not of all chosen ones: no more are held against the others."""
    _, ents = _random_entities(spark)
    chosen = F.col("doc_id") % 20 == 0
    every = {tuple(r) for r in relations.pair_relations(ents, chosen, at_once=4).collect()}
    read, blocks = [], search.blocks
    monkeypatch.setattr(search, "blocks", lambda *a: (read.append(len(b)) or b for b in blocks(*a)))
    for some in ({0, 7, 20, 33}, {5}, set()):
        read.clear()
        of = spark.createDataFrame([(d,) for d in some], "doc_id long")
        got = [tuple(r) for r in relations.related(relations.weighted_rows(ents), chosen, of, at_once=3).collect()]
        assert sorted(got) == sorted(r for r in every if {r[0], r[1]} & some)
        assert sum(read) == len(some)


def test_shares_of_a_querys_entities(spark):
    rows, ents = _random_entities(spark)
    asked = {1: ["e1", "e2", "e3", "none"], 2: ["e5"], 3: ["none"]}
    queries = spark.createDataFrame([(q, e) for q, es in asked.items() for e in es], "query_id long, entity string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in relations.worded(relations.weighted_rows(ents), queries, 6).collect())
    want = []
    for q, es in asked.items():
        shares = {d: round(len({e for dd, e, _ in rows if dd == d} & set(es)) / len(es), 6) for d in range(120)}
        best = sorted((-s, d) for d, s in shares.items() if s >= 0.2)[:6]
        want += [(q, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    assert got == sorted(want)


def test_a_blocks_terms_take_no_more_room_than_they_are():
    """Common terms of rows and queries as a dense product has them, from a table as large as the queries' terms."""
    rng = np.random.default_rng(8)
    names = pa.array(sorted(f"t{i}" for i in range(50)), pa.string())
    lists = [sorted({names[int(i)].as_py() for i in rng.integers(0, 50, n)}) for n in (0, 1, 5, 30)]
    weights = [rng.random(len(ts)) for ts in lists]
    terms = search.Terms(names, lists, weights)
    assert len(terms.query) == len(terms.weight) == sum(map(len, lists)) and len(terms.starts) == 51
    dense, rows = np.zeros((50, 4)), rng.random((6, 50)) * (rng.random((6, 50)) < 0.3)
    for q, (ts, w) in enumerate(zip(lists, weights, strict=True)):
        dense[[names.index(t).as_py() for t in ts], q] = w
    row, code = np.nonzero(rows)
    sums, both = terms.met_twice(6, row, code, rows[row, code])
    assert np.allclose(sums, rows @ dense) and (both == (rows > 0).astype(int) @ (dense > 0).astype(int)).all()
    assert np.allclose(terms.met(6, row, code, rows[row, code]), sums)
