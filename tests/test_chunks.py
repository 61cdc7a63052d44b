import pytest

from millrace.operators.chunks import chunk_text, chunks, sections, split_block
from millrace.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_sections():
    text = "intro\n\n# A\none\ntwo\n\nthree\n## 目录\ngone\n### C\n```\n# code\n\nmore\n```\n"
    assert sections(text) == [([], 0, ["intro"]), (["A"], 1, ["one\ntwo", "three"]), (["A", "C"], 3, ["```\n# code\n\nmore\n```"])]
    assert chunk_text(text) == [("A", "intro\none\ntwo\nthree"), ("C", "【A / C】\n```\n# code\n\nmore\n```")]
    assert chunk_text("") == chunk_text(" \n\n") == []


@pytest.mark.parametrize("unit", ["word, ", "x", "One. Two! "])
def test_split_loses_nothing(unit):
    block = unit * 900
    parts = split_block(block, 500, 64)
    assert all(len(p) <= 500 for p in parts)
    assert parts[0] + "".join(p[64:] for p in parts[1:]) == block
    assert split_block("short", 500, 64) == ["short"]


def test_documents(spark):
    docs = table(spark, SF, "documents")
    got = chunks(docs).collect()
    assert max(len(r.text) for r in got) <= 1000
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.position)):
        words.setdefault(r.doc_id, []).extend(r.text.split())
    for d, text in texts.items():
        whole = [w for w in (text or "").split() if len(w) < 64]
        assert not text or not text.strip() or "#" in text or set(whole) <= set(words[d])
    assert chunks(docs.where("false")).count() == 0
