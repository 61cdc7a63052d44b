"""Column expressions over text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
#: A run of letters and digits; a Chinese sign is a token of its own.
TOKEN = rf"[{_HAN}]|[\p{{L}}\p{{N}}&&[^{_HAN}]]+"
#: Whether there are three tokens; nothing is read past the third, and no sign twice.
THREE_TOKENS = rf"^(?:[^\p{{L}}\p{{N}}{_HAN}]*+(?:[{_HAN}]|[\p{{L}}\p{{N}}&&[^{_HAN}]]++)){{3}}"
#: A word's edge among letters of ASCII, digits and _, as RE2's: Java's own edges follow other letters too, by its release.
WORD_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
#: Function words left out of the first lexical pass, by language.
STOP_WORDS = [
    *("the and of to in is a an are as at be by for from has have he it its not on or that this was were which with you".split()),
    *("der die das den dem des ein eine einer und oder nicht von zu mit auf für ist sind war im am als auch sich".split()),
    *("le la les un une des du de et ou ne pas que qui dans pour sur avec est sont au aux par ce cette".split()),
    *("el los las una y o no en por para con es son del al se su lo como más".split()),
    *("的 了 和 是 在 有 与 及 或 不 也 就 这 那 被 把 对 为".split()),
]
STOP_WORDS = list(dict.fromkeys(STOP_WORDS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def token_estimate(text: Column) -> Column:
    """0 for no text, else a token for every one and a half characters, one at least."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 1.5))).cast("long")


def token_bucket(token: Column) -> Column:
    """One of 4096 = 16 ** 3 dimensions: the last three hex digits of the token's md5."""
    return F.conv(F.right(F.md5(token), F.lit(3)), 16, 10).cast("int")


def partial_mask(value: Column) -> Column:
    """Short values keep their ends, longer ones the first three and the last four signs."""
    n = F.length(value)  # fixed values: the lengths at which the form changes, and what stays
    star = F.lit("*")
    return (
        F.when(n <= 1, value)
        .when(n <= 3, F.concat(F.substring(value, 1, 1), F.repeat(star, n - 1)))
        .when(n <= 7, F.concat(F.substring(value, 1, 1), F.repeat(star, n - 2), F.right(value, F.lit(1))))
        .otherwise(F.concat(F.substring(value, 1, 3), F.repeat(star, n - 7), F.right(value, F.lit(4))))
    )


def luhn_valid(digits: Column) -> Column:
    """The checksum of card numbers: from the right every second digit doubled, nines cast out, the sum a multiple of 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _nfc(text: Column) -> Column:
    """Canonical composition, which Spark has no function for; a batch at a time."""

    def composed(rows: pd.Series) -> pd.Series:
        return rows.str.normalize("NFC")

    return F.pandas_udf(composed, "string")(text)


def clean_text(text: Column) -> Column:
    """Line ends, control characters, canonical composition, invisible and private-use characters, lines that are a
    marker only (page, image), full-width forms, spaces between CJK signs, trailing space, blank lines, in this order."""
    # The characters that each step takes.
    full = "".join(map(chr, range(0xFF01, 0xFF5F))) + chr(0x3000)
    half = "".join(map(chr, range(0x21, 0x7F))) + " "
    cjk = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
    first = [(r"\r\n?", "\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")]
    then = [
        (r"[\x{FEFF}\x{200B}-\x{200F}\x{00AD}\x{2060}]", ""),
        (r"[\x{2028}\x{2029}]", "\n"),
        (r"[\x{2009}\x{200A}\x{00A0}]", " "),
        (r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]", ""),
        (r"(?m)^[ \t]*<!--[^\n]*-->[ \t]*$", ""),
    ]
    last = [(f"(?<={cjk}) (?={cjk})", ""), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n")]
    for pattern, by in first:
        text = F.regexp_replace(text, pattern, by)
    text = _nfc(text)
    for pattern, by in then:
        text = F.regexp_replace(text, pattern, by)
    text = F.translate(text, full, half)
    for pattern, by in last:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(20[0-9]{2})"), 1))


#: What becomes of a page's markup, in this order: pattern and what stands for it.
HTML_STEPS = [
    (r"(?is)<script[ >].*?</script>", ""),
    (r"(?is)<style[ >].*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body)([ /][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"[ \t\r]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]


def html_text(html: Column) -> Column:
    """A page's text: scripts, styles, comments and tags taken out, block tags as line ends, five entities and the
    fixed space read. Null stays null."""
    for pattern, by in HTML_STEPS:
        html = F.regexp_replace(html, pattern, by)
    return html
