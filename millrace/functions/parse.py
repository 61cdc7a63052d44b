"""Files' bytes to text, by the suffix of their names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import html_text

#: Suffixes by what is done with them; others are not supported.
PLAIN, HTML = ("txt", "md", "csv", "json", "xml"), ("html", "htm")


def decoded(content: Column, fallback: str = "GBK") -> Column:
    """UTF-8 where the bytes are that, else ``fallback``, which Spark decodes itself if it knows it; bytes that are
    wrong there become replacement signs. A byte-order mark goes."""

    def by_name(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: b.decode(fallback, "replace"), na_action="ignore")

    known = fallback.upper() in ("ISO-8859-1", "UTF-16", "UTF-32", "US-ASCII")
    other = F.decode(content, fallback) if known else F.pandas_udf(by_name, "string")(content)
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(other)
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def parsed(name: Column, content: Column, fallback: str = "GBK") -> Column:
    """(text, error) of a file: plain suffixes decoded, pages freed of their markup, an error for other suffixes and
    for a null content."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    text = decoded(content, fallback)
    out = F.when(suffix.isin(*PLAIN), text).when(suffix.isin(*HTML), html_text(text))
    error = F.when(content.isNull(), "no content").when(~suffix.isin(*PLAIN, *HTML), F.concat(F.lit("unsupported suffix: "), suffix))
    return F.struct(F.when(error.isNull(), out).alias("text"), error.alias("error"))


def table_prose(table: Column, most: int = 4) -> Column:
    """A Markdown table of up to ``most`` rows as sentences, 'header value' pairs of a row side by side; a larger one, or
    what is no table, stays as it is."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
    lines = F.filter(F.split(table, "\n", -1), lambda x: F.trim(x) != "")
    heads = cells(F.get(lines, F.lit(0)))
    body = F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))
    row = lambda x: F.array_join(F.filter(F.zip_with(heads, cells(x), lambda h, v: F.concat_ws(" ", h, v)), lambda p: F.trim(p) != ""), ", ")
    is_table = (F.size(lines) >= 3) & F.get(lines, F.lit(1)).rlike(r"^\s*\|?\s*:?-{2,}")
    return F.when(is_table & (F.size(body) <= most), F.array_join(F.transform(body, row), "\n")).otherwise(table)
