"""Spelling variants: words one edit apart, found by bit-sliced position indexes over the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import parallelism, runs, spool

#: A maximal run of letters; the range is a fixed value of the contract and holds two signs that are no letters.
RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typo(run: Column, doc: Column, every: int) -> Column:
    """The run, without one letter where ``every`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of ``least`` letters or more that all texts together hold ``times`` times or more.

    Words are maximal runs of ``RUN``, A-Z lower-cased; shorter runs cannot become such words and are not taken
    from the texts. ``every``: with the deletions of ``typo``. Null and empty texts have none. Counts are summed in
    each task before they move, so a frequent word is as cheap as a rare one.
    """
    found = docs.select(F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))
    low = F.translate("run", UPPER, LOWER)
    word = low if every is None else typo(low, F.col("doc"), every)
    return found.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


class PositionIndex:
    """For each position and letter the set of words with that letter there, as bits over the words."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """codes: a row of letters for each word, filled up with -1; letters are numbers from 0."""
        words, width = codes.shape
        self.codes, self.lengths, self.slots = codes, lengths, -(-words // 64)
        self.letters = int(codes.max(initial=-1)) + 1
        self.sets = np.zeros(((width + 2) * (self.letters + 1), self.slots), np.uint64)  # with a position past the last, and no letter
        rows, at = np.nonzero(codes >= 0)
        np.bitwise_or.at(self.sets, (at * (self.letters + 1) + codes[rows, at], rows >> 6), np.uint64(1) << (rows & 63).astype(np.uint64))
        self.of_length = np.zeros((width + 3, self.slots), np.uint64)
        every = np.arange(words)
        np.bitwise_or.at(self.of_length, (lengths, every >> 6), np.uint64(1) << (every & 63).astype(np.uint64))

    def near(self, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word, other) that differ by exactly one inserted, deleted or replaced letter, in both orders.

        Words of one length are run through the index side by side. After i letters, ``zero`` has the words that begin
        with these i letters, ``replaced``, ``longer`` and ``shorter`` those that match them with one error, whose
        further letters are looked up at the same, the next and the previous position.
        """
        for length in np.unique(self.lengths).tolist():
            of_this = np.flatnonzero(self.lengths == length)
            step = max(1, block // max(1, self.slots))
            for start in range(0, len(of_this), step):
                yield from self._matches(of_this[start : start + step], length)

    def _matches(self, rows: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        here = lambda at, i: self.sets[at * (self.letters + 1) + self.codes[rows, i]]
        zero = np.full((len(rows), self.slots), ~np.uint64(0))
        replaced, longer, shorter = np.zeros_like(zero), np.zeros_like(zero), np.zeros_like(zero)
        for i in range(length):
            same = here(i, i)
            shorter = zero | (shorter & here(i - 1, i)) if i else zero.copy()
            longer = (longer | zero) & here(i + 1, i)
            replaced = (replaced & same) | zero
            zero = zero & same
        one = (replaced & ~zero & self.of_length[length]) | ((longer | zero) & self.of_length[length + 1])
        if length:
            one |= shorter & self.of_length[length - 1]
        q, slot = np.nonzero(one)
        bits = np.unpackbits(one[q, slot].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        if len(hit):
            yield rows[q[hit]], slot[hit] * 64 + bit


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of letter numbers, and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    codes = np.full((len(words), int(lengths.max(initial=0))), -1, np.int64)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.unique(flat, return_inverse=True)[1].reshape(-1)
    return codes, lengths


def _window_keys(low: str, high: str) -> Column:
    """The bucket of a word: its pair length, the window the edit lies in, and all letters outside the window."""
    head, tail = F.expr(f"substr(word, 1, {low})"), F.expr(f"right(word, pair - {high})")
    return F.md5(F.concat_ws("/", F.col("pair").cast("string"), F.expr(low).cast("string"), F.expr(high).cast("string"), head, tail))


def dealt_words(words: DataFrame, most: int) -> DataFrame:
    """unit, word, n: words that may be one edit apart share a unit; units have about ``most`` words, and at most four times as many.

    Let a pair's shorter word have L letters. Cut the places of an edit into two windows: either the letters before the
    later one or those after the earlier one are equal. So each word goes, as the shorter and as the longer of a
    pair, to a bucket for each window, named by the letters outside it. A bucket with more words is cut again, its
    window halved, so no pair is lost; at a window of one place all but two letters are named, and a bucket has fewer
    words than letters squared. Buckets with a single word go; small ones share a unit, as an index tells pairs of
    different buckets apart by itself.
    """
    whole = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("pair"))
    open_ = whole.select("*", F.lit(0).alias("low"), F.col("pair").alias("high"))
    parts = []
    while True:
        middle = "CAST((low + high) DIV 2 AS INT)"
        halves = open_.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
        halves = halves.select(
            "word", "n", "pair", F.expr(f"IF(half = 0, low, {middle})").alias("low"), F.expr(f"IF(half = 0, {middle}, high)").alias("high")
        ).where("high > low")
        keyed = spool(halves.withColumn("bucket", F.unhex(_window_keys("low", "high"))), "word-buckets")
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.max("word").alias("last"), F.min("word").alias("first"))
        sizes = spool(sizes.where("first <> last").select("bucket", "size"), "bucket-sizes")  # a word may be both its shorter and its longer one
        sized = spool(keyed.join(sizes.hint("merge"), "bucket"), "sized-buckets")
        parts.append(sized.where((F.col("size") <= most) | (F.col("high") - F.col("low") <= 1)))
        open_ = sized.where((F.col("size") > most) & (F.col("high") - F.col("low") > 1)).drop("bucket", "size")
        if open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    units = max(1, -(-out.count() // most))
    few = F.concat(F.lit("few/"), F.pmod(F.xxhash64("bucket"), F.lit(units)).cast("string"))
    return out.select(F.when(F.col("size") * 4 < most, few).otherwise(F.hex("bucket")).alias("unit"), "word", "n").distinct()


def near_words(words: DataFrame, most: int = 2048) -> DataFrame:
    """word, near, near_n: all pairs of ``words`` (word, n) that are one edit apart, each in both orders and once."""
    dealt = dealt_words(words, most)
    dealt = dealt.repartition(parallelism(words.sparkSession) * 4, "unit").sortWithinPartitions("unit", "word")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "unit"):
            names, n = rows.column("word"), rows.column("n")
            for a, b in PositionIndex(*coded(names.to_pylist())).near():
                b = pa.array(b)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(b), n.take(b)], ["word", "near", "near_n"])

    return dealt.mapInArrow(search, "word string, near string, near_n bigint").distinct()


def spelling_variants(words: DataFrame, ratio: int = 10, most: int = 2048) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of ``words`` (word, n; words are distinct and not null).

    A word's form is the near word that stands most often, if ``ratio`` times as often as the word or more; ties go to
    the first in code-point order. Else form and form_n are null. root follows the forms to the last, and is the word
    itself without one. n_near counts the near words, 0 if none. Other columns are left out; no words give no rows.
    """
    if ratio < 2:
        raise ValueError("a form stands at least twice as often as its word, else forms may go round")
    words = spool(words.select("word", "n"), "words")
    near = near_words(words, most)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    counts = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(counts, "word", "left")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    forms = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).cast("long").alias("form_n"),
    )
    forms = spool(forms, "forms")
    # each form stands ``ratio`` times as often, so chains are short and end; every round doubles the way that is known
    ways = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = spool(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ways = met.select("word", "root")
        if met.where("moved").isEmpty():
            break
    return forms.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
