"""Best-fit packing of token pieces by exact complements."""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, running_before, spool


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters that Unicode normalization leaves alone, lower-cased, then ASCII marks: one word of each to the tokenizer.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: The letter that stands for each byte in the vocabulary: visible Latin-1 for itself, the others from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER = {b: b for b in _SEEN} | {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _SEEN)}


class WordTokens:
    """Token ids (unsigned 32-bit, little-endian) of texts, run by run.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its runs without ASCII
    white space in turn. A block of texts is split and its distinct runs are named in Arrow; only these are looked up,
    and numpy puts their ids in the texts' order. Short runs are kept in two generations: when the young one is full it becomes
    the old one, from which runs that come again move back, so common runs outlive rare ones.
    """

    def __init__(self, path: str, keep: int = 300_000):
        self.keep = keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {"": b""}

    def _word(self, word: str) -> bytes:
        """The ids of one word that needs neither normalizing nor splitting."""
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTER)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _learn(self, run: str) -> bytes:
        plain = _PLAIN.fullmatch(run.lower())
        if not plain:
            return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        word, marks = plain.groups()
        ends = self.marks.get(marks)
        if ends is None:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            ends = self.marks[marks] = self._word(marks)
        return self._word(word) + ends

    def _look_up(self, runs: list[str]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, runs))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            run = runs[i]
            out[i] = ids = self.old.get(run) or self._learn(run)
            if len(run) < 40:
                self.young[run] = ids
        return out

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and where each text's ids stop. A null text is empty.

        A-Z are lower-cased first, as the tokenizer does, but where special tokens may stand.
        """
        texts = pc.fill_null(texts, "")
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lower)  # gives empty runs at the ends, which have no ids
        named = split.flatten().dictionary_encode()
        known = [*self._look_up(named.dictionary.to_numpy(zero_copy_only=False).tolist()), end.to_bytes(4, "little")]
        flat, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        stops = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        runs = np.insert(named.indices.to_numpy(zero_copy_only=False), stops, len(known) - 1)
        n = size[runs]
        after = np.cumsum(n)
        at = np.repeat((first[runs] - after + n).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], after[stops + np.arange(len(stops))]


@lru_cache(maxsize=2)
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked) of each piece of each document's ids and ``end``.

    A document of over ``capacity`` ids is cut into pieces of that many, the last one being the rest. A null text is
    empty: its one piece is the end id. Rows that repeat give their pieces again. Other columns are left out, so their
    names do not matter; an empty table gives an empty one. ``tokenizer`` is a file's path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer)
        for b in blocks(batches, 1, 8 << 20):
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            ids, stops = tokens.ids(b.column(1), end)
            for i, (low, high) in enumerate(itertools.pairwise([0, *stops.tolist()])):
                for k, at in enumerate(range(low, high, capacity)):
                    part = ids[at : min(high, at + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(at - low)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Sums:
    """The lengths that are left, found by the sum of one, two or three of them.

    ``left`` says how often each length is left and only falls. For a sum that is asked for, the pairs that make it
    are listed once; pairs whose lengths are used up are dropped when they are met, and a sum that no pair or triple
    makes is remembered.
    """

    def __init__(self, left: dict[int, int]):
        self.left = left
        self.pairs: dict[int, list[int]] = {}
        self.no_triple: set[int] = set()

    def _listed(self, total: int) -> list[int]:
        """The larger halves of the pairs that make ``total``, the largest last."""
        found = self.pairs.get(total)
        if found is None:
            lengths = np.fromiter(self.left, np.int64, len(self.left))
            there = np.zeros(total + 1, bool)
            there[lengths[lengths <= total]] = True
            larger = np.arange((total + 1) // 2, total)
            found = self.pairs[total] = larger[there[larger] & there[total - larger]].tolist()
        return found

    def pair(self, total: int, first: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """``first`` and two lengths that sum to ``total``, each as often as it is left."""
        listed = self._listed(total)
        while listed and not (self.left.get(listed[-1]) and self.left.get(total - listed[-1])):
            listed.pop()
        for a in reversed(listed):
            chosen = (*first, a, total - a)
            if all(self.left.get(k, 0) >= chosen.count(k) for k in chosen):
                return chosen
        return None

    def exact(self, total: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are left and sum to ``total``; fewer are better, then a longer first."""
        if self.left.get(total):
            return (total,)
        if found := self.pair(total):
            return found
        if total not in self.no_triple:
            for a in sorted((k for k in self.left if total <= 3 * k < 3 * total), reverse=True):
                if found := self.pair(total - a, (a,)):
                    return found
            self.no_triple.add(total)
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, how many in each bin)]) until every length's count is used up.

    From the longest length down: the gap is filled exactly by one, two or three lengths that are left; where none
    fit, by the longest that fits, again and again. A pattern is used as often as the counts allow, so there are few
    patterns however many pieces there are.
    """
    left = {k: n for k, n in counts.items() if n}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    sums, plan = Sums(left), []
    order = sorted(left)  # those that are used up are dropped

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            del order[bisect.bisect_left(order, length)]

    while left:
        longest = order[-1]
        used = {longest: 1}
        take(longest, 1)
        gap = capacity - longest
        while gap:
            chosen = sums.exact(gap)
            if not chosen:
                fits = bisect.bisect_right(order, gap)
                if not fits:
                    break
                chosen = (order[fits - 1],)
            for k in chosen:
                used[k] = used.get(k, 0) + 1
                take(k, 1)
                gap -= k
        more = min(left.get(k, 0) // n for k, n in used.items())
        for k, n in used.items():
            if more:
                take(k, n * more)
        plan.append((1 + more, sorted(used.items(), reverse=True)))
    return plan


def pack(pieces: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces, in as few sequences of ``capacity`` as it finds.

    Only the number of pieces of each length comes down, at most ``capacity`` rows; the plan made of it says which
    ranks of each length go where. Ranks are running counts over ranges of a hash, so a length that most pieces have
    is split over tasks. An empty table stays empty.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows, sequence = [], 0
    ranks = dict.fromkeys(counts, 0)
    for bins, used in plan_bins(counts, capacity):
        offset = 0
        for length, n in used:
            rows.append((length, ranks[length], sequence, offset, n))
            ranks[length] += bins * n
            offset += length * n
        sequence += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    # lengths times a rank's range make one sorted key; ranks stay under 2 ** 48
    starts = (table[:, 0] << np.int64(48)) + table[:, 1]
    sent = pieces.sparkSession.sparkContext.broadcast((starts, table))  # bounded by the number of lengths, not of pieces

    ranked = running_before(
        pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(512))), ["length"], "_bucket", list(order), F.lit(1), "_rank"
    ).drop("_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table = sent.value
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            found = table[np.searchsorted(starts, (length << np.int64(48)) + rank, "right") - 1]
            nth = rank - found[:, 1]
            keep = [i for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(found[:, 2] + nth // found[:, 4]), pa.array(found[:, 3] + nth % found[:, 4] * length)],
                [*(b.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, F.col("_rank").cast("bigint").alias("_rank")).mapInArrow(
        run, f"{kinds}, sequence_id bigint, offset bigint"
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = False, **columns) -> DataFrame:
    """The pieces of ``docs``, packed."""
    return pack(spool(cut_pieces(docs, tokenizer, capacity, with_ids=with_ids, **columns), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the token ids of each sequence, from packed pieces with their ids; at most a capacity each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
