"""Terms in texts by the automaton against naive scans."""

import random
import re

from pyspark.sql import functions as F

from millrace.operators import terms

RULES = [
    ("metric", "营业收入", "营业收入", 0), ("metric", "国际收入", "国际收入", 1), ("metric", "收入", "收入", 2), ("metric", "增长", "增长", 3), ("metric", "同比增长", "同比增长", 4),
    ("entity", "国际", "国际", 0), ("entity", "海外", "国际", 1), ("entity", "挖掘机械", "挖掘机械", 2), ("unit", "亿元", "亿元", 0), ("unit", "亿", "亿", 1), ("unit", "%", "%", 2),
    ("scope", "合并", "合并报表", 0), ("scope", "母公司", "母公司", 1),
]


def test_hits_are_all_places(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé𝒳中") for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "ab" * 40_000]
    names = sorted({"".join(rng.choice("abé𝒳中") for _ in range(rng.randrange(1, 4))) for _ in range(40)}) + ["ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    rules = spark.createDataFrame([(t,) for t in [*names, "", None, names[0]]], "term string")
    want = sorted((i, m.start(), m.start() + len(t), t) for i, x in enumerate(texts) if x for t in set(names) for m in re.finditer(f"(?={re.escape(t)})", x))
    for size in (terms.BLOCK_BYTES, 20):  # one automaton, and a rule table in blocks
        assert sorted(map(tuple, terms.term_hits(docs, "text", rules, "id", block_bytes=size).collect())) == want
    assert terms.term_hits(docs, "text", rules.where("false"), "id").count() == 0
    assert terms.term_hits(docs.where("false"), "text", rules, "id").count() == 0


def test_first_in_the_list(spark):
    rules = spark.createDataFrame([("归母净利润", "a", 0), ("净利润", "b", 1), ("营收", "c", 2)], "term string, name string, priority int")
    docs = spark.createDataFrame([(1, "营收与净利润"), (2, "归母净利润和营收"), (3, "无"), (4, None)], "id int, text string")
    assert sorted(map(tuple, terms.first_in_list(docs, "text", rules, "id").collect())) == [(1, "b"), (2, "a")]


def test_conflict_keys(spark):
    rules = spark.createDataFrame(RULES, "kind string, term string, name string, priority int")
    docs = spark.createDataFrame(
        [
            (1, "国际收入485亿元,同比增长12.15%", "合并报表/一", " 2024 "), (2, "挖掘机械营业收入达到3,000亿。海外" + "x" * 40 + "7", "母公司", None),
            (3, None, None, "2023"), (4, "8", "x" * 50 + "合并", ""), (5, "收入" + "y" * 28 + "1亿元 收入" + "y" * 29 + "2", None, "2022"),
        ],
        "doc_id long, text string, section string, period string",
    )
    got = {(r.doc_id, r.value): (r.metric, r.entity, r.unit, r.scope, r.period) for r in terms.conflict_keys(docs, rules).collect()}
    assert got == {
        (1, "485"): ("国际收入", "国际", "亿元", "合并报表", "2024"), (1, "12.15"): ("增长", "国际", "%", "合并报表", "2024"),
        (2, "3,000"): ("营业收入", "挖掘机械", "亿", "母公司", ""), (2, "7"): ("unknown", "whole", "unknown", "母公司", ""),
        (4, "8"): ("unknown", "whole", "unknown", "default", ""), (5, "1"): ("收入", "whole", "亿元", "default", "2022"), (5, "2"): ("unknown", "whole", "unknown", "default", "2022"),
    }


def test_boosts_multiply_once_a_rule(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, "en en", "a|b|c"), (1, 2, 1.0, "de", "a"), (2, 1, 2.0, None, "|")], "query_id long, doc_id long, score double, lang string, text string")
    rules = spark.createDataFrame([("lang", "en", 1.5), ("text", "|", 2.0), ("text", "b", 3.0), ("text", "", 9.0)], "place string, term string, factor double")
    got = {(r.query_id, r.doc_id): r.score for r in terms.boosted(hits, ["lang", "text"], rules).collect()}
    assert got == {(1, 1): 9.0, (1, 2): 1.0, (2, 1): 4.0}
    assert {r.score for r in terms.boosted(hits, ["lang"], rules.where(F.lit(False))).collect()} == {1.0, 2.0}
