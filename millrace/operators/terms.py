"""Terms of a rule table found in texts by an automaton, and what is picked from them: keywords, conflict keys, boosts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.pii import cut, let, pieces, spans
from millrace.sources.written import spool

#: Bytes of terms that one automaton takes; a larger rule table is taken in blocks, each with a pass over the texts.
BLOCK_BYTES = 16 << 20
#: How many signs before a value name it, behind it have its unit, and of a section's path have its scope.
BEFORE, BEHIND, HEAD = 30, 10, 50
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


@lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Compiled once in a worker, for all batches of a block."""
    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, (i, len(t)))
    out.make_automaton()
    return out


def term_hits(rows: DataFrame, text_col: str, rules: DataFrame, *keep: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep``, start, end (places from 0), term of every place at which a term of ``rules`` (term, ...) stands
    in the text, overlapping ones included. Null and empty texts and terms give none; a term that repeats counts once.

    The rules' bytes are counted first: they are read and broadcast in blocks of about ``block_bytes``, dealt by hash.
    """
    spark = rows.sparkSession
    terms = rules.where("length(term) > 0").select("term").distinct()
    parts = -(-(terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // block_bytes)
    texts = rows.select(*keep, F.col(text_col).alias("text_"))
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep), "start int", "end int", "term string"])
    out = None
    for part in range(parts):
        block = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).orderBy("term").toPandas()["term"]
        sent = spark.sparkContext.broadcast(tuple(block))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            if not sent.value:
                return
            automaton, names = _automaton(sent.value), pa.array(sent.value, pa.string())
            for b in batches:
                row, end, which, size = [], [], [], []
                for i, text in enumerate(b.column(len(keep)).to_pylist()):
                    for at, (n, length) in automaton.iter(text or ""):
                        row.append(i)
                        end.append(at + 1)
                        which.append(n)
                        size.append(length)
                ends = np.array(end, np.int32)
                taken = [b.column(c).take(pa.array(row, pa.int64())) for c in range(len(keep))]
                places = [pa.array(ends - np.array(size, np.int32), pa.int32()), pa.array(ends, pa.int32())]
                yield pa.RecordBatch.from_arrays([*taken, *places, names.take(pa.array(which, pa.int64()))], [*keep, "start", "end", "term"])

        found = texts.where("length(text_) > 0").mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def first_in_list(rows: DataFrame, text_col: str, rules: DataFrame, id_col: str) -> DataFrame:
    """id and name: of the ``rules`` (term, name, priority) whose term stands in the text the one of least priority."""
    hits = term_hits(rows, text_col, rules, id_col).select(id_col, "term").distinct().join(rules, "term")
    return hits.groupBy(id_col).agg(F.min(F.struct("priority", "name"))["name"].alias("name"))


def numbers(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, end, value of each number in a text, with what stands before and behind it."""
    t = F.struct(F.col(text_col).alias("text"), pieces(F.col(text_col)).alias("parts"))
    zero = F.lit(0)

    def around(t: Column) -> Column:
        one = lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            cut(t["parts"], F.greatest(s["start"] - BEFORE, zero), s["start"]).alias("before"), cut(t["parts"], s["end"], s["end"] + BEHIND).alias("behind"),
        )
        return F.transform(spans(t["text"], NUMBER), one)

    return docs.select(F.col(id_col).alias("doc_id"), F.inline(let(t, around)))


def conflict_keys(docs: DataFrame, rules: DataFrame, unknown: str = "unknown", whole: str = "whole", default_scope: str = "default") -> DataFrame:
    """doc_id, start, value and the key of each number of ``docs`` (doc_id, text, section, period): entity, metric, period,
    unit, scope.

    ``rules`` are (kind, term, name, priority). metric: the name of the term that ends last within the ``BEFORE`` signs
    before the number, ties to the least priority; entity: of the terms there, that of least priority, else ``whole``;
    unit: the longest term right behind the number; scope: of the terms in the first ``HEAD`` signs of the section, that of
    least priority, else ``default_scope``. A field that no rule names is ``unknown``; a null period is empty. Ids are
    distinct. Terms are found in short windows, of each number once, however long a text is.
    """
    of = lambda kind: rules.where(F.col("kind") == kind).select("term", "name", "priority")
    values = spool(numbers(docs), "numbers")
    key = ["doc_id", "start"]
    named = values.select("doc_id", F.col("start").alias("at"), "before")
    unit_of = values.select("doc_id", F.col("start").alias("at"), "behind")
    metric = term_hits(named, "before", of("metric"), "doc_id", "at").join(of("metric"), "term")
    metric = metric.groupBy("doc_id", "at").agg(F.max(F.struct("end", (-F.col("priority")).alias("p"), "name"))["name"].alias("metric"))
    entity = term_hits(named, "before", of("entity"), "doc_id", "at").join(of("entity"), "term")
    entity = entity.groupBy("doc_id", "at").agg(F.min(F.struct("priority", "name"))["name"].alias("entity"))
    unit = term_hits(unit_of, "behind", of("unit"), "doc_id", "at").where("start = 0").join(of("unit"), "term")
    unit = unit.groupBy("doc_id", "at").agg(F.max(F.struct("end", "name"))["name"].alias("unit"))
    heads = docs.select("doc_id", F.substring("section", 1, HEAD).alias("head"))
    scope = first_in_list(heads, "head", of("scope"), "doc_id").withColumnRenamed("name", "scope")
    out = values.select(*key, "value")
    for part in (metric, entity, unit):
        out = out.join(part.withColumnRenamed("at", "start"), key, "left")
    out = out.join(docs.select("doc_id", F.coalesce(F.trim("period"), F.lit("")).alias("period")), "doc_id").join(scope, "doc_id", "left")
    missing = {"metric": unknown, "entity": whole, "unit": unknown, "scope": default_scope}
    return out.select(*key, "value", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in missing.items()), "period")


def boosted(hits: DataFrame, columns: list[str], rules: DataFrame) -> DataFrame:
    """``hits`` (query_id, doc_id, score, ...) with the score times the factors of all ``rules`` (place, term, factor) whose
    term stands in the column ``place``; a rule counts once, and one whose term is empty never."""
    total = None
    for place in columns:
        own = rules.where(F.col("place") == place)
        met = term_hits(hits, place, own, "query_id", "doc_id").select("query_id", "doc_id", "term").distinct().join(own, "term")
        total = met if total is None else total.unionByName(met)
    factors = total.groupBy("query_id", "doc_id").agg(F.product("factor").alias("factor"))
    return hits.join(factors, ["query_id", "doc_id"], "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")
