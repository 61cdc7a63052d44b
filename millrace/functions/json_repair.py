"""Objects that a model wrote, made readable for a JSON parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_THINKING = re.compile(r"(?s)<think>.*?</think>")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_KEY = re.compile(r"\s*:")


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that begins with the quote at ``at``, in double quotes, and where it ends. Within it nothing is mended
    but that the other kind of quote is set off."""
    quote, out = text[at], ['"']
    at += 1
    while at < len(text) and text[at] != quote:
        if text[at] == "\\" and at + 1 < len(text):
            out.append(text[at + 1] if text[at + 1] == "'" else text[at : at + 2])
            at += 2
            continue
        out.append('\\"' if text[at] == '"' else text[at])
        at += 1
    return "".join([*out, '"']), at + 1


def _object(text: str, at: int) -> tuple[str | None, int]:
    """The object that begins at ``at``: strings in double quotes, keys quoted, no comma before a closing bracket; and
    where it ends. None if it does not end."""
    out: list[str] = []
    open_: list[str] = []
    while at < len(text):
        c = text[at]
        if c in "\"'":
            part, at = _string(text, at)
            out.append(part)
            continue
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_.pop() != c:
                return None, at
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            out.append(c)
            at += 1
            if not open_:
                return "".join(out), at
            continue
        elif (word := _WORD.match(text, at)) and _KEY.match(text, word.end()) and open_[-1] == "}":
            out.append(f'"{word.group()}"')
            at = word.end()
            continue
        out.append(c)
        at += 1
    return None, at


def _tried(text: str) -> Iterator[str]:
    at = text.find("{")
    while at >= 0:
        part, end = _object(text, at)
        if part is not None:
            yield part
        at = text.find("{", end if part is not None else at + 1)


def mended(text: str | None) -> str | None:
    """The text, if it is an object as it stands; else the first part of it that is one once its quotes, keys and commas
    are mended, leaving byte-order mark, thinking part, fences and prose aside. Null if there is none.

    A valid object is never changed, and neither is what stands within a string. A text is read once for each opening
    brace that is never closed, which in what a model writes are few.
    """
    if text is None:
        return None
    bare = text.strip().removeprefix("﻿").strip()
    if _is_object(bare):
        return bare
    bare = _THINKING.sub("", bare).strip()
    if _is_object(bare):
        return bare
    return next((part for part in _tried(bare) if _is_object(part)), None)


def repaired(text: Column) -> Column:
    """``mended`` texts, a batch at a time."""

    def mend(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: mended(t if isinstance(t, str) else None))

    return F.pandas_udf(mend, "string")(text)
