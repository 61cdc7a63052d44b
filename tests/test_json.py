"""Mended objects and JSON Lines: valid ones never change."""

import json
import random

import pytest

from millrace.functions.json_repair import mended
from millrace.sources.jsonl import read_rows


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choice("a'\"{}[]:, \\\n,}é") for _ in range(rng.randrange(12)))
    if kind in (1, 2, 3):
        return [rng.randrange(100), True, None][kind - 1]
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b c", "it's", "k_1", '"q"']): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def loose(value, rng):
    """The value as a careless writer would put it."""
    if isinstance(value, dict):
        items = []
        for k, v in value.items():
            bare = k.isidentifier() and rng.random() < 0.5
            items.append((k if bare else loose(k, rng)) + " : " + loose(v, rng))
        return "{" + ", ".join(items) + (", " if items and rng.random() < 0.5 else "") + "}"
    if isinstance(value, list):
        return "[" + ",".join(loose(v, rng) for v in value) + (" ,\n" if value and rng.random() < 0.5 else "") + "]"
    if isinstance(value, str) and rng.random() < 0.5:
        return "'" + json.dumps(value)[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
    return json.dumps(value)


@pytest.mark.parametrize("seed", range(300))
def test_mended(seed):
    rng = random.Random(seed)
    value = {"x": made(rng), "it's": made(rng), "y": made(rng)}
    valid = json.dumps(value, ensure_ascii=rng.random() < 0.5)
    assert mended(valid) == valid
    careless = loose(value, rng)
    for text in (careless, f"﻿<think>{{no}}</think>Sure:\n```json\n{careless}\n```\nDone {{.", f"{{not one}} {valid} and more"):
        assert json.loads(mended(text)) == value


def test_what_is_no_object():
    assert [mended(t) for t in (None, "", "[1]", "{", "{'a': }", "no", "}{", "{]", "{'a")] == [None] * 9
    assert mended("{}") == "{}" and mended('{"a": "x, y: \'z\'"}') == '{"a": "x, y: \'z\'"}'
    assert mended("{" * 3000) is None


def test_rows_of_a_file(spark, tmp_path):
    lines = ['{"id": 1, "text": "it\'s, fine: {x}"}', "{'id': 2, text: 'b',}", "", "   ", '{"id": "no", "text": "c"}', "[1, 2]", "broken {", '{"id": 3}', '{"id": 4, "more": 1, "text": null}']
    (tmp_path / "rows.jsonl").write_text("\n".join(lines), encoding="utf-8")
    schema = spark.createDataFrame([], "id long, text string").schema
    got = sorted((r.status, r.id or 0, r.text or "", r.line or "") for r in read_rows(spark, str(tmp_path), schema).collect())
    assert got == sorted([
        ("read", 1, "it's, fine: {x}", ""), ("read", 3, "", ""), ("read", 4, "", ""), ("mended", 2, "b", lines[1]),
        ("corrupt", 0, "", lines[4]), ("corrupt", 0, "", "[1, 2]"), ("corrupt", 0, "", "broken {"),
    ])
