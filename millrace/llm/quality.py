"""Quality rules: fixed limits on document statistics, then boosted trees over the same statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.gbt import Forest, fit

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
#: name and the sign of its constraint: more symbols, repeats or double lines never raise the score
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1,
    "upper_share": -1, "distinct_share": 0, "short_share": 0, "digit_share": -1, "mark_share": 0, "words_per_line": 0,
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MARKS = re.compile(r"[!?.,;:]+")


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of a text, and its features; null counts as empty. Words split at ASCII white space."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    lines = doubles = 0
    for line in text.encode().split(b"\n"):
        if line.strip():
            lines += 1
            doubles += line in seen
            seen.add(line)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeats = 0
    if n >= 4:  # a window found twice needs four words
        m = len(index)
        pair = ids[:-1] * m + ids[1:]
        if m > 1 << 20:  # the product of three would not fit
            pair = np.unique(pair, return_inverse=True)[1].reshape(-1)
        _, inverse, counts = np.unique(pair[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
        often = counts[inverse.reshape(-1)] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= often
        repeats = int(covered.sum())
    some, some_chars = max(n, 1), max(chars, 1)
    upper = sum(map(str.isupper, text))
    short = sum(len(w) <= 2 for w in words)
    features = [
        float(np.log1p(n)), chars / some, symbols / some, repeats / some, doubles / max(lines, 1), upper / some_chars,
        len(index) / some, short / some, sum(map(str.isdigit, text)) / some_chars,
        len(_MARKS.findall(text)) / some, n / max(lines, 1),
    ]
    return [n, chars, symbols, doubles, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trees for labels.quality (0 or 1) from at most about ``sample`` labelled documents, chosen by a hash of the id.

    The sample is what bounds the driver's share: its rows come down as features, without texts. Labels of null
    quality or id do not count; an id that repeats counts as often as it stands. Without both classes the forest is
    empty and scores everything alike.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("_id"), "quality")
    n = usable.count()
    share = min(1.0, sample / max(n, 1))
    chosen = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [document_stats(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")
    rows = texts.select("_text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "x array<double>, y int")
    got = rows.toPandas()
    got = got.assign(order=got["x"].map(tuple)).sort_values(["order", "y"])  # partitions arrive in any order
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy(float), np.array(list(FEATURES.values())))


def judge(
    docs: DataFrame, forest: Forest, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """doc_id, the five counts, base_failed, score and kept of each row; columns named in ``keep`` come along.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept: not base_failed, and a
    score of ``least`` or more. Null and empty texts have no words and fail. Rows that repeat are judged one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # trees of fixed depth: a few hundred nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [document_stats(t) for t in b.column(0).to_pylist()]
            counts = np.array([m[0] for m in made], np.int64).reshape(-1, 5)
            score = sent.value.probability(np.array([m[1] for m in made], float).reshape(-1, len(FEATURES)))
            failed = np.array([base_failed(int(c[0]), int(c[4])) for c in counts], bool)
            new = [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *new], [*b.schema.names[1:], *STATS, "base_failed", "score", "kept"])

    carried = keep if keep is not None else []
    data = docs.select(
        F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *(F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(carried))
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema.fields[1:])
    return data.mapInArrow(
        run, f"{kinds}, {', '.join(f'{s} bigint' for s in STATS)}, base_failed boolean, score double, kept boolean"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``, whatever their names. Null and empty texts fail; with
    labels that are empty or of one class only the fixed limits count. An empty table gives an empty one."""
    judged = judge(docs, train(docs, labels), keep=docs.columns)
    return judged.where("kept").select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)))
