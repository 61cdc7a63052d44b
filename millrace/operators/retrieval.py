"""Lexical, vector and hybrid retrieval for many queries at once, and what is done to ranked hits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import STOP_WORDS, THREE_TOKENS, token_bucket, tokens
from millrace.operators import search
from millrace.operators.postings import SENT, PostingsIndex, counted_terms, saturation
from millrace.sources.written import folder, spool

RRF_K = 60
#: Dimensions of the hashed bag of words.
DIMENSIONS = 4096


@dataclass(frozen=True)
class RetrievalFilter:
    """None leaves a field open; an empty set lets nothing through. ``columns`` maps fields to a table's columns."""

    years: frozenset[int] | None = None
    document_ids: frozenset[int] | None = None
    section_names: frozenset[str] | None = None
    source_types: frozenset[str] | None = None
    kb_ids: frozenset[str] | None = None

    def predicate(self, **columns: str) -> Column:
        names = {"document_ids": "doc_id", "kb_ids": "kb_id"} | columns
        wanted = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}
        if missing := sorted(set(wanted) - set(names)):
            raise ValueError(f"no column is named for {missing}")
        return reduce(Column.__and__, (F.col(names[f]).isin(*sorted(values)) for f, values in wanted.items()), F.lit(True))


def acl_predicate(roles: list[int], user: int | None, read_all: bool = False) -> Column:
    """Public rows, rows whose roles the reader shares, and the reader's own."""
    if read_all:
        return F.lit(True)
    shared = F.col("visibility").isin("internal", "restricted") & F.arrays_overlap("allowed_roles", F.array(*(F.lit(r) for r in roles)).cast("array<int>"))
    return (F.col("visibility") == "public") | shared | (F.col("owner") == user if user is not None else F.lit(False))


def top(df: DataFrame, k: int, by: str = "query_id", score: str = "score", id_col: str = "doc_id") -> DataFrame:
    """The ``k`` best of each query with their rank from 1; ties to the smaller id."""
    w = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, stop: bool) -> DataFrame:
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.where(~F.col("term").isin(STOP_WORDS)) if stop else terms


def bm25(docs: DataFrame, queries: DataFrame, k: int, stop: bool = True, index: PostingsIndex | None = None) -> DataFrame:
    """query_id, doc_id, score, rank of the ``k`` best documents of each query that share a term with it.

    ``index`` is one of ``docs``. Without it their texts are read once, the queries' terms are counted in them, and the
    counts are scored where they are, so that no posting is shuffled; too many terms to send are met in an index of them.
    """
    asked = spool(query_terms(queries, stop), "query-terms")
    if index is not None:
        return index.search(asked, k)
    terms = sorted(asked.select("term").distinct().limit(SENT + 1).toPandas()["term"])
    if len(terms) > SENT:
        return PostingsIndex.build(docs, folder(docs.sparkSession, "postings"), parts=8, only=asked).search(asked, k)
    counted = spool(counted_terms(docs, terms, places=True), "counted-terms")
    total = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    mean = total.mean or 1.0  # no words: no hits
    df = np.zeros(len(terms))
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
    df[found["term"]] = found["df"]
    idf = np.log(1 + (total.docs - df + 0.5) / (df + 0.5))
    names = pa.array(terms, pa.string())
    place = {t: i for i, t in enumerate(terms)}

    def sent():
        for block in search.blocks(asked.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))):
            yield block["query_id"].tolist(), search.Terms(names, block["terms"], [idf[[place[t] for t in ts]] for ts in block["terms"]])

    weighed = search.bm25_scores(partial(saturation, mean=mean))
    return search.top_in_blocks(counted, sent(), weighed, k).select("query_id", "doc_id", "score", "rank")


def hashed_words(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and dims: the hashed dimension of each token, repeats included; null texts have none."""
    dims = F.transform(tokens(F.coalesce("text", F.lit(""))), token_bucket)
    return df.select(*keep, dims.alias("dims"))


def bow_cosine(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", group: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank of the ``k`` best documents of each query (and group) by the cosine of their
    hashed bags of words; documents without a dimension in common are left out."""

    def vectors():
        for block in search.blocks(hashed_words(queries, "query_id")):
            unit = np.zeros((DIMENSIONS, len(block)))
            query, dim, weight = search.unit_counts(pa.array(block["dims"].tolist(), pa.list_(pa.int32())), DIMENSIONS)
            unit[dim, query] = weight
            yield block["query_id"].tolist(), unit

    return search.top_in_blocks(hashed_words(docs, id_col, *([group] if group else [])), vectors(), search.count_scores(DIMENSIONS), k, id_col, group)


def questions(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, position, text of the questions that a document answers; here its first ``most`` lines of three tokens or more."""
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.lower(line).rlike(THREE_TOKENS))
    return docs.select("doc_id", F.posexplode(F.slice(lines, 1, most)).alias("position", "text"))


def question_channel(asked: DataFrame, queries: DataFrame, k: int, most: int = 3) -> DataFrame:
    """query_id, doc_id, score, rank: documents by the nearest of their questions (doc_id, position, text).

    No document has more than ``most`` questions, so the ``k`` best documents are among the k * ``most`` best questions.
    """
    keyed = asked.withColumn("question", F.col("doc_id") * most + F.col("position"))  # of equal scores the smaller id's come first
    near = bow_cosine(keyed, queries, k * most, "question")
    of = F.call_function("div", F.col("question") - F.pmod("question", F.lit(most)), F.lit(most)).cast(asked.schema["doc_id"].dataType)
    best = near.withColumn("doc_id", of).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top(best, k).select("query_id", "doc_id", "score", "rank")


def rrf(channels: list[tuple[DataFrame, float]], k: int, by: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked channels (query_id, doc_id, rank from 1)."""
    parts = None
    for df, weight in channels:
        one = df.select(by, "doc_id", (F.lit(float(weight)) / (RRF_K + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    fused = parts.groupBy(by, "doc_id").agg(F.round(F.sum("part"), 8).alias("score"))
    return top(fused, k, by)


def channels(docs: DataFrame, queries: DataFrame, fetch: int = 20, index: PostingsIndex | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranked hits by hashed words, by terms and by questions. ``index``: as ``bm25`` takes it."""
    return bow_cosine(docs, queries, fetch), bm25(docs, queries, fetch, index=index), question_channel(questions(docs), queries, fetch)


def fused(ranked: Sequence[DataFrame], k: int = 10, question_weight: float = 0.15) -> DataFrame:
    """Vector, lexical and question channel fused; weights 1, 1 and ``question_weight``."""
    return rrf(list(zip(ranked, (1.0, 1.0, question_weight), strict=True)), k)


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 10, fetch: int = 20, question_weight: float = 0.15, index: PostingsIndex | None = None) -> DataFrame:
    """The channels of a search, fused."""
    return fused(channels(docs, queries, fetch, index), k, question_weight)


def with_fallback(found: DataFrame, relaxed: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than ``k`` hits, none included, get the unseen hits of the relaxed channel at half weight,
    its ranks counted anew among them. ``relaxed`` has the 2 * ``k`` best of each query or more."""
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    unseen = relaxed.join(full, "query_id", "left_anti").join(found, ["query_id", "doc_id"], "left_anti").drop("rank")
    extra = top(unseen, k).select("query_id", "doc_id", F.round(0.5 / (RRF_K + F.col("rank")), 8).alias("score"))
    return top(found.select("query_id", "doc_id", "score").unionByName(extra), k)


def merged(ranked: DataFrame, k: int, group: str = "kb_id") -> DataFrame:
    """One list a query of lists per ``group`` (query_id, doc_id, group, score): the first group's row of a document
    stands, then the best come first."""
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(group, F.desc("score")))
    return top(ranked.withColumn("first", first).where("first = 1").drop("first"), k)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """Exact cosine top-k of a stated set of queries (query_id, qv) against all other rows (vec_id, v)."""
    blocks = ((b["query_id"].tolist(), (np.array(b["qv"].tolist(), float), b["query_id"].to_numpy(np.int64))) for b in search.blocks(queries))
    keep = ["vec_id", "v", *([group] if group else [])]
    return search.top_in_blocks(vectors.select(*keep), blocks, search.cosine_scores("v", "vec_id"), k, "vec_id", group)


def mmr(hits: DataFrame, keep: int = 5, balance: float = 0.7, group: str | None = None, most: int = 2, penalty: float = 0.1) -> DataFrame:
    """Maximal marginal relevance over (query_id, vec_id, score, v), few candidates a query: the picks in order.

    Relevance is min-max scaled within the query, 1 where all are equal; ties go to the earlier candidate. With a
    ``group`` column a candidate whose group has been picked ``most`` times or more loses ``penalty`` for each pick
    from that number on."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        s = rows["score"].to_numpy()
        rel = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
        x = np.array(rows["v"].tolist(), float)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        of = rows["_group"].to_numpy()
        near, taken = np.zeros(len(s)), np.zeros(len(s))
        chosen: list[int] = []
        while len(chosen) < min(keep, len(s)):
            gain = balance * rel - (1 - balance) * near - penalty * np.maximum(0, taken - most + 1) * (group is not None)
            gain[chosen] = -np.inf
            best = int(np.round(gain, 9).argmax())
            near = x @ x[best] if not chosen else np.maximum(near, x @ x[best])
            taken = taken + (of == of[best])
            chosen.append(best)
        out = rows.loc[chosen, ["query_id", "vec_id", "score"]]
        return out.assign(pick=range(1, len(chosen) + 1))

    rows = hits.select("query_id", "vec_id", "score", "v", (F.col(group) if group else F.lit(0)).alias("_group"))
    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, score double, pick int")


def diverse(hits: DataFrame, most: int, group: str) -> DataFrame:
    """The best of each group first, then the rest, up to ``most`` a query."""
    in_group = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    ordered = hits.withColumn("again", (in_group > 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("again", "rank"))
    return ordered.withColumn("place", place).where(F.col("place") <= most)


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id and doc_id where the document's text contains the item's text; null texts contain nothing.

    A task reads its documents once for each block of items. An item's longest inner word, which a document that
    contains the item has as a word too, finds the candidates among a document's words; containment decides. Items of
    fewer than three words have no inner word and are held against every text of the task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"query_id long, doc_id {kind}")
    for block in search.blocks(items.where("text is not null").select("query_id", "text")):
        inner = [max(t.split(" ")[1:-1], key=len, default="") for t in block["text"]]
        anchors = sorted({w for w in inner if w})
        held: dict[str, list[int]] = {}
        for i, w in enumerate(inner):
            held.setdefault(w, []).append(i)
        sent = docs.sparkSession.sparkContext.broadcast((block["query_id"].tolist(), block["text"].tolist(), pa.array(anchors, pa.string()), held))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, texts, anchors, held = sent.value
            short = held.get("", [])
            for b in batches:
                words = pc.split_pattern(b.column(1), " ")
                at = pc.fill_null(pc.index_in(words.flatten(), anchors), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
                pairs = np.unique(row[at >= 0] * max(1, len(anchors)) + at[at >= 0])
                found = []
                for i, a in zip((pairs // max(1, len(anchors))).tolist(), (pairs % max(1, len(anchors))).tolist(), strict=True):
                    body = b.column(1)[i].as_py()
                    found += [(ids[n], i) for n in held[anchors[a].as_py()] if texts[n] in body]
                for i in range(b.num_rows if short else 0):
                    body = b.column(1)[i].as_py()
                    found += [(ids[n], i) for n in short if texts[n] in body]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), b.column(0).take(pa.array([f[1] for f in found], pa.int64()))], ["query_id", "doc_id"]
                )

        bodies = docs.where("text is not null").select("doc_id", "text")
        out = out.unionByName(bodies.mapInArrow(find, f"query_id bigint, doc_id {kind}"))
    return out.distinct()
