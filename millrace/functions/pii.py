"""Personal data: the rules, their checks, and spans and masks as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import luhn_valid, partial_mask


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    check: str
    excluded: tuple[str, ...] = ()
    strategy: str = "mask"
    active: bool = True


# Patterns, words that mark an example, weights and check digits of the rules.
EXAMPLE_WORDS = ("示例", "例如", "举例", "模板", "demo", "test", "测试", "sample")
RULES = [
    Rule("cn_id_card", r"\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b", "id_card", EXAMPLE_WORDS),
    Rule("cn_phone", r"\b1[3-9]\d{9}\b", "phone", EXAMPLE_WORDS),
    Rule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "email", EXAMPLE_WORDS),
    Rule("cn_bank_card", r"\b[1-5]\d{14,18}\b", "bank_card", EXAMPLE_WORDS),
    Rule("cn_passport", r"\b[1-9]\d{8}\b", "passport", active=False),
    Rule("cn_bank_card_unionpay", r"\b6[02589]\d{14,17}\b", "bank_card", EXAMPLE_WORDS),
]
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def id_card_valid(value: Column) -> Column:
    """18 signs whose last is the check of the weighted first 17, by 11."""
    digits = F.transform(F.split(F.substring(value, 1, 17), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    weighted = F.aggregate(F.zip_with(digits, F.array(*(F.lit(w) for w in ID_WEIGHTS)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    return value.rlike(r"^\d{17}.$") & (F.upper(F.substring(value, 18, 1)) == F.substring(F.lit(ID_CHECKS), weighted % 11 + 1, F.lit(1)))


#: Checks by name.
CHECKS = {
    "id_card": id_card_valid,
    "phone": lambda v: v.rlike(r"^1[3-9]\d{9}$"),
    "email": lambda v: F.substring_index(v, "@", -1).contains("."),
    "bank_card": lambda v: v.rlike(r"^\d{15,19}$") & luhn_valid(F.when(v.rlike(r"^\d+$"), v)),
    "passport": lambda v: v.rlike(r"^[1-9]\d{8}$"),
}


#: Signs of a piece of a text, and entries of a piece of an array: what is looked up or grown a piece at a time takes time
#: in proportion to the text, where the whole would have to be walked or copied for each match.
PIECE, ENTRIES = 1024, 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often lambdas in ``body`` name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The signs from ``start`` to before ``end`` (places from 0) of a text in ``pieces``; past its end there are none."""
    first = F.floor(start / PIECE).cast("int")
    many = F.floor((end - 1) / PIECE).cast("int") - first + 1
    return F.when(end <= start, "").otherwise(F.substring(F.array_join(F.slice(parts, first + 1, many), ""), (start % PIECE + 1).cast("int"), end - start))


def _chunks(values: Column) -> Column:
    """The array in arrays of ``ENTRIES``; null for a null one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(ENTRIES))
    return F.when(values.isNotNull(), F.transform(starts, lambda i: F.slice(values, i, F.lit(ENTRIES))))


def sums_before(values: Column) -> Column:
    """For each entry of an array of ints the sum of those before it."""

    def of_chunks(chunks: Column) -> Column:
        total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
        begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
        grown = F.aggregate(chunks, begin, lambda s, c: F.struct(F.array_append(s["starts"], s["at"]).alias("starts"), (s["at"] + total(c)).alias("at")))
        inside = lambda c, at: F.transform(c, lambda _, j: at + total(F.slice(c, F.lit(1), j)))
        return let(grown["starts"], lambda starts: F.flatten(F.zip_with(chunks, starts, inside)))

    return let(_chunks(values), of_chunks)


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches of ``pattern``, places from 0: the lengths of what lies between the
    matches, and of the matches before, say where each one is."""

    def placed(s: Column) -> Column:
        lengths = F.transform(s["found"], lambda m, i: F.length(m) + F.length(F.get(s["between"], i + 1)))
        first = F.length(F.get(s["between"], F.lit(0)))
        return F.zip_with(
            s["found"], sums_before(lengths),
            lambda m, at: F.struct((first + at).alias("start"), (first + at + F.length(m)).alias("end"), m.alias("value")),
        )

    return let(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("found")), placed)


def _excluded(parts: Column, span: Column, words: tuple[str, ...], reach: int) -> Column:
    """Whether a word stands within ``reach`` signs of the span; words of Latin letters count as whole words only."""
    if not words:
        return F.lit(False)
    around = cut(parts, F.greatest(span["start"] - reach, F.lit(0)), span["end"] + reach)
    latin = [w for w in words if w.isascii()]
    pattern = "|".join([*(rf"\b(?:{'|'.join(latin)})\b" for _ in latin[:1]), *(w for w in words if not w.isascii())])
    return around.rlike(f"(?i){pattern}")


def findings(text: Column, rules: list[Rule] | None = None, reach: int = 20) -> Column:
    """Array of (start, place, rule, strategy, end, value) of all active rules' matches that pass their check and have no
    excluded word near, in the order of their starts and then of the rules; null for a null text.

    Each rule's pattern runs over the text once, and a match looks at the pieces of the text around it, so the time grows
    with the text and its matches, not with their product.
    """
    every = rules if rules is not None else RULES
    active = [(place, rule) for place, rule in enumerate(every) if rule.active]
    return let(F.struct(text.alias("text"), pieces(text).alias("parts")), lambda t: F.sort_array(F.concat(*(_of_rule(t, rule, place, reach) for place, rule in active))))


def _of_rule(t: Column, rule: Rule, place: int, reach: int) -> Column:
    good = F.filter(spans(t["text"], rule.pattern), lambda s: CHECKS[rule.check](s["value"]) & ~_excluded(t["parts"], s, rule.excluded, reach))
    fixed = [F.lit(place).alias("place"), F.lit(rule.name).alias("rule"), F.lit(rule.strategy).alias("strategy")]
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), *fixed, s["end"].alias("end"), s["value"].alias("value")))


def masked(text: Column, found: Column) -> Column:
    """The text with each finding to be masked partly starred out; one that overlaps an earlier one is left aside."""

    def starred(t: Column) -> Column:
        none = F.array().cast("array<string>")

        def step(state: Column, f: Column) -> Column:
            new = F.concat(cut(t["parts"], state["at"], f["start"]), partial_mask(f["value"]))
            return F.when(f["start"] >= state["at"], F.struct(F.array_append(state["out"], new).alias("out"), f["end"].alias("at"))).otherwise(state)

        def of_chunk(state: Column, chunk: Column) -> Column:
            inner = F.aggregate(chunk, F.struct(none.alias("out"), state["at"].alias("at")), step)
            return let(inner, lambda s: F.struct(F.array_append(state["out"], F.array_join(s["out"], "")).alias("out"), s["at"].alias("at")))

        whole = F.aggregate(_chunks(t["kept"]), F.struct(none.alias("out"), F.lit(0).alias("at")), of_chunk)
        return let(whole, lambda s: F.concat(F.array_join(s["out"], ""), cut(t["parts"], s["at"], F.length(t["text"]))))

    kept = F.filter(found, lambda f: f["strategy"] == "mask")
    return let(F.struct(text.alias("text"), pieces(text).alias("parts"), kept.alias("kept")), starred)
