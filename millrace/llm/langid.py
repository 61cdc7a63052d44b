"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks

_LETTER = regex.compile(r"\p{L}")


def ngram_hashes(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of each run of ``n`` code points."""
    h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the lower-cased texts, a space put before and after each, and where each text's stop."""
    spaced = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    stops = np.cumsum([len(s) // 4 for s in spaced], dtype=np.int64)
    return np.frombuffer(b"".join(spaced), np.uint32).astype(np.uint64), stops


def ngrams(texts: list[str], orders: tuple[int, ...], bits: int, step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's place, bucket) of every n-gram of the texts, a bounded number at a time, in the order of the texts.

    An n-gram lies within one text; long texts are walked with an overlap, so none is lost or made up between parts.
    """
    codes, stops = code_points(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(stops, prepend=0))
    for start in range(0, len(codes), step):
        for n in orders:
            bucket = ngram_hashes(codes[start : start + step + n - 1], n, bits)
            of = owner[start : start + len(bucket)]
            inside = of == owner[start + n - 1 : start + n - 1 + len(bucket)]
            yield (of, bucket) if inside.all() else (of[inside], bucket[inside])


@dataclass(frozen=True)
class Model:
    """log_prob: buckets x languages; prior: languages."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """texts x languages: the product of the texts' sparse n-gram counts and the log-probabilities, with the prior."""
        total = np.tile(self.prior.astype(float), (len(texts), 1))
        for owner, bucket in ngrams(texts, self.orders, self.bits):
            if len(owner):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[starts]] += np.add.reduceat(self.log_prob[bucket], starts, axis=0)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Of each text the likeliest language and its posterior; 'und' and 0 for one that is null or has no letter."""
        named, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if self.languages and t is not None and _LETTER.search(t)]
        odds = self.log_odds([texts[i] for i in rows])
        if rows:
            best = odds.argmax(axis=1)
            odds = np.exp(odds - odds.max(axis=1, keepdims=True))
            score[rows] = odds[np.arange(len(rows)), best] / odds.sum(axis=1)
            for i, k in zip(rows, best.tolist(), strict=True):
                named[i] = self.languages[k]
        return named, score


def train(
    labelled: DataFrame, sample: int = 4000, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, smoothing: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Counts n-grams of at most about ``sample`` documents a language, chosen by a hash of the id.

    Rows without text or language teach nothing. Languages are few; what comes down to the driver is at most one
    count for each of them and each of the 2 ** bits buckets. Without labelled rows the model has no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), orders, bits)
    share = F.create_map(*(c for k in languages for c in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))))
    chosen = rows.where(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)) * 1_000_000
    ).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {k: i for i, k in enumerate(languages)}
        counts = np.zeros((len(languages), 1 << bits), np.int64)
        for b in blocks(batches, 1, 4 << 20):
            lang = np.array([at[k] for k in b.column(0).to_pylist()], np.int64)
            for owner, bucket in ngrams(b.column(1).to_pylist(), orders, bits):
                counts += np.bincount((lang[owner] << bits) + bucket, minlength=counts.size).reshape(counts.shape)
        i, bucket = counts.nonzero()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(bucket), pa.array(counts[i, bucket])], ["i", "bucket", "n"])

    counted = chosen.mapInArrow(run, "i bigint, bucket bigint, n bigint").groupBy("i", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((1 << bits, len(languages)), smoothing)
    counts[counted["bucket"].to_numpy(int), counted["i"].to_numpy(int)] += counted["n"].to_numpy(float)
    prior = np.array([sizes[k] for k in languages], float)
    log_prob = np.log(counts / counts.sum(axis=0))
    return Model(languages, log_prob, np.log(prior / prior.sum()), orders, bits)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row. Only the text is looked at, and all of it. The model is broadcast:
    2 ** bits x languages floats; a batch of texts is scored at once. Of languages that are equally likely the first by
    code point is named. Rows that repeat are predicted one by one, null ids like others. Other columns are left out,
    so their names do not matter; an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 1, 1 << 20):
            named, score = sent.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id has none and is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
