"""Personal data, tags, years, repaired JSON and cleaning on small hand-made cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import pii
from millrace.functions.json_repair import repaired
from millrace.functions.parse import parsed, table_prose
from millrace.functions.text import clean_text, tokens
from millrace.functions.years import head_year, name_year, query_years
from millrace.operators.tags import TagParser, tag_parts
from millrace.plans import registry
from millrace.plans.answers import question_kinds


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        ("write to a.b@mail.example.com now", ["email"]), ("call 13800138000 now", ["cn_phone"]), ("call 12800138000 now", []),
        ("card 4111111111111111 ok", ["cn_bank_card"]), ("card 4111111111111112 ok", []), ("card 6222020000000000005 x", []),
        ("id 11010519491231002X here", ["cn_id_card"]), ("id 110105194912310021 here", []), ("号码 13800138000，示例", []),
        ("a test: 13800138000", []), ("a contest: 13800138000", ["cn_phone"]), (f"test{' ' * 30}13800138000", ["cn_phone"]), (None, None), ("", []),
    ],
)
def test_pii_rules(spark, text, rules):
    found = one(spark, text, pii.findings)
    assert (None if found is None else [f.rule for f in found]) == rules
    for f in found or []:
        assert text[f.start : f.end] == f.value


def test_pii_masks_in_place_and_skips_overlaps(spark):
    text = "id 11010519491231002X, mail ab@cd.org and 4111111111111111."
    got = one(spark, text, lambda t: pii.masked(t, pii.findings(t)))
    assert got == "id 110***********002X, mail ab@**.org and 411*********1111."
    twice = [pii.Rule("a", r"\d{4}", "any"), pii.Rule("b", r"\d{6}", "any")]
    pii.CHECKS["any"] = lambda v: v.isNotNull()
    assert one(spark, "x 123456 y", lambda t: pii.masked(t, pii.findings(t, twice))) == "x 1**456 y"
    assert one(spark, "nothing here", lambda t: pii.masked(t, pii.findings(t))) == "nothing here"


def test_tags_do_not_hang_on_where_pieces_end():
    rng = random.Random(1)
    for whole in (
        "<think>first</think>  answer", "plain only", "a < b <thin x", "<think>never closed", "\n\n<think>a</think>\n<answer>b</answer>", "</think>late", "x</thi", "<answer>b</answer> c",
    ):
        parser = TagParser()
        want = parser.feed(whole) + parser.feed("", last=True)
        want = {k: "".join(t for kind, t in want if kind == k) for k in ("answer", "thinking")}
        for _ in range(20):
            parser, parts, at = TagParser(), [], 0
            while at < len(whole):
                n = rng.randint(1, 4)
                parts += parser.feed(whole[at : at + n])
                at += n
            parts += parser.feed("", last=True)
            got = {k: "".join(t for kind, t in parts if kind == k) for k in ("answer", "thinking")}
            if "</think>" not in whole or whole.split("</think>")[1] == whole.split("</think>")[1].lstrip():
                assert got == want, whole
            assert got["thinking"] == want["thinking"], whole


def test_tag_parts_by_conversation(spark):
    rows = [(1, 1, "k>in</th"), (1, 0, "<thin"), (1, 2, "ink>out"), (2, 0, None), (2, 1, "plain")]
    got = {r.conv_id: (r.thinking, r.answer) for r in tag_parts(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got == {1: ("in", "out"), 2: ("", "plain")}


@pytest.mark.parametrize(
    ("text", "years"),
    [("2023", [2023]), ("2023-25", [2023, 2024, 2025]), ("2025至2023, 2021", [2023, 2024, 2025, 2021]), ("2020 and 2020", [2020]), ("4527 or 1999", None), ("2031", None), ("", None), (None, None)],
)
def test_query_years(spark, text, years):
    assert one(spark, text, query_years) == years


@pytest.mark.parametrize(
    ("text", "year"),
    [
        ("1999 公司 2021 年 3 月, 2022年 报告, 报告期: 2023 年, 2024年度报告", 2024), ("1999 年 2021 年 3 月, 2022 年 报告, 报告年度：2023", 2023),
        ("1999, 2021 年 3 月, 2022 年 报告", 2022), ("1999, 2021年12月", 2021), ("1999, 2021 年", 1999), ("no", None), (None, None),
    ],
)
def test_report_years_by_form(spark, text, year):
    assert one(spark, text, head_year) == year


@pytest.mark.parametrize(
    ("text", "years"),
    [("近三年营收", [2021, 2022, 2023]), ("2023年与近3年", [2023, 2021, 2022]), ("2024", [2024]), ("近年", None), (None, None)],
)
def test_the_last_three_years(spark, text, years):
    known = F.array(F.lit(2023), F.lit(2021), F.lit(None).cast("int"), F.lit(2022), F.lit(2021))
    assert one(spark, text, lambda t: query_years(t, known)) == years


def test_document_years(spark):
    assert one(spark, "report-2021.pdf", name_year) == 2021 and one(spark, "report", name_year) is None
    assert one(spark, "x" * 1600 + " 2020", head_year) is None and one(spark, "in 1998 and 2020", head_year) == 1998


@pytest.mark.parametrize(
    ("text", "k"),
    [("{\"k\": 1}", "1"), ("﻿<think>{x}</think>```json\n{k: '1',}\n```", "1"), ("here: {'k': '1'} so", "1"), ("no object", None), ("[1, 2]", None)],
)
def test_repaired_json(spark, text, k):
    got = one(spark, text, lambda t: F.from_json(repaired(t), "k string")["k"])
    assert got == k


def test_cleaning(spark):
    text = "a\r\nb\x01 é​ \n<!-- page 3 -->\nＡ１　中 文 字  \n\n\n\n  end "
    assert one(spark, text, clean_text) == "a\nb é \n\nA1 中文字\n\n  end".replace("é \n", "é\n")


def test_parsing_by_suffix(spark):
    rows = [("a.TXT", "é".encode()), ("b.md", "中文".encode("gbk")), ("c.html", b"<p>x &amp; y</p>"), ("d.exe", b"1"), ("noname", b"1"), ("e.txt", None), ("f.csv", b"\xef\xbb\xbfa,b")]
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows], "name string, content binary")
    got = [tuple(r.p) for r in df.select(parsed(F.col("name"), F.col("content")).alias("p")).collect()]
    assert got == [("é", None), ("中文", None), ("x & y", None), (None, "unsupported suffix: exe"), (None, "unsupported suffix: "), (None, "no content"), ("a,b", None)]


def test_small_tables_become_prose(spark):
    small = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |  |"
    assert one(spark, small, table_prose) == "a 1, b 2\na 3, b "
    large = small + "\n| 5 | 6 |" * 4
    assert one(spark, large, table_prose) == large and one(spark, "no table", table_prose) == "no table"


def test_tokens_of_mixed_scripts(spark):
    assert one(spark, "Ab中文c-3é, x", lambda t: tokens(t)) == ["ab", "中", "文", "c", "3é", "x"]


def test_pii_of_many_matches_takes_time_in_proportion(spark):
    """Spans, exclusions and masks of a page of contacts are those of a plain scan, and 32,000 addresses are no problem."""
    import re
    import time

    def page(n):
        return "".join(f"名前{i} x{i}.y@mail{i % 7}.example.org, {'test' if i % 11 == 0 else 'tel'} 1380000{i % 10000:04d};\n" for i in range(n))

    def plain(text):
        out = []
        for place, pattern in ((1, r"\b1[3-9]\d{9}\b"), (2, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")):
            for m in re.finditer(pattern, text, re.ASCII):
                around = text[max(0, m.start() - 20) : m.end() + 20]
                if not re.search(r"(?i)\b(?:demo|test|sample)\b", around, re.ASCII):
                    out.append((m.start(), place, m.end(), m.group()))
        return sorted(out)

    took = {}
    for n in (700, 16000):
        text = page(n)
        began = time.time()
        row = spark.createDataFrame([(text,)], "text string").select(pii.findings(F.col("text")).alias("found"), "text").select("found", pii.masked(F.col("text"), F.col("found")).alias("masked")).first()
        took[n] = time.time() - began
        want = plain(text)
        assert [(f.start, f.place, f.end, f.value) for f in row.found] == want
        at, out = 0, []
        for start, _, end, value in want:
            out += [text[at:start], value[:3] + "*" * (len(value) - 7) + value[-4:]]
            at = end
        assert row.masked == "".join([*out, text[at:]])
    assert took[16000] < 60


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("undäge und sich", (True, False, False)), ("und sich", (False, False, False)), ("éhow so", (True, False, False)), ("showé", (False, False, False)),
        ("verſus", (True, False, False)), ("a?\r\u2028b?", (False, True, False)), ("a?\nb?", (False, False, False)), ("2011\r2012", (False, False, True)), (None, (None, None, None)),
    ],
)
def test_kinds_of_questions_by_their_sql(spark, text, kinds):
    df = spark.createDataFrame([(text,)], "text string").select(*question_kinds(F.col("text")))
    assert tuple(df.first()) == kinds
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark AS SELECT 1 AS item_id, ?::VARCHAR AS text", [text])
    assert con.execute(registry.oracles()["query_kinds"]).fetchall() == [(1, *kinds)]


def test_personal_data_by_its_sql(spark, tmp_path):
    """Example words, edges beside other letters, several rules at one place, mails right behind each other."""
    texts = [
        "enlichö test lmd.56@mail9.example.com der", "demo 4111111111111111 sample 6222020000000000005", "äabcdefg@mail.deü 号码13800138000号", "13800138000@mail.example.com", "x_13800138000 13800138000x 4111111111111112",
        "write abc@mail.com.x@other.mail.de.", "%abcd@mail.com -ab.cd@mail.com", "id 11010519491231002X", "a\r\nabcd@mail.com\u2028efgh@mail.de", "nothing", "", None,
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*r, "en", "src1", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("pii_findings", "pii_masked", "pii_alerts"):
        df = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(registry.oracles()[name])
        assert df.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
