"""Years in names, texts and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A year; the forms in which a report's head names its own, the surest first; the years that a question may
# name, a range of them, and its words for the last three.
YEAR = r"(?:19|20)[0-9]{2}"
REPORT_YEARS = [rf"({YEAR})\s*年(?:度报告|年度报告|年报)", rf"报告(?:期|年度)\s*[:：]\s*({YEAR})", rf"({YEAR})\s*年\s*报告", rf"({YEAR})\s*年\s*\d+\s*月"]
FIRST, LAST = 2020, 2029
RANGE = r"20[2-9]\d\s*[-–—~至到]\s*(?:20[2-9]\d|\d{2})"
RECENT = "近三年|近3年"


def _year(text: Column, pattern: str = f"({YEAR})") -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.cast("int"))


def name_year(name: Column) -> Column:
    """The first year in a name; null if it has none."""
    return _year(name)


def head_year(text: Column, reach: int = 1500) -> Column:
    """The year that the first ``reach`` signs name: as that of a report, in the first form that stands there; else the
    first year of all; else null."""
    head = F.substring(text, 1, reach)
    return F.coalesce(*(_year(head, p) for p in REPORT_YEARS), _year(head))


def query_years(text: Column, known: Column | None = None) -> Column:
    """The years of 2020 to 2029 that a question names, in order and once each: first those of its ranges, filled up
    and read either way round, then single ones outside of ranges. A question about the last three years also gets those of
    ``known``, an array of the corpus' years, in their order. Null if there are none."""

    def span(found: Column) -> Column:
        a = F.substring(found, 1, 4).cast("int")
        end = F.regexp_extract(found, r"(\d+)$", 1)
        b = F.when(F.length(end) == 2, F.floor(a / 100) * 100 + end.cast("int")).otherwise(end.cast("int")).cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    ranged = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({RANGE})"), 1), span))
    single = F.transform(F.regexp_extract_all(F.regexp_replace(text, RANGE, " "), F.lit(r"(20[2-9]\d)"), 1), lambda y: y.cast("int"))
    years = F.array_distinct(F.filter(F.concat(ranged, single), lambda y: y.between(FIRST, LAST)))
    if known is not None:
        recent = F.when(text.rlike(RECENT), F.sort_array(F.filter(known, lambda y: y.isNotNull())))
        years = F.array_distinct(F.concat(years, F.coalesce(recent, F.array().cast("array<int>"))))
    return F.when(F.size(years) > 0, years)
