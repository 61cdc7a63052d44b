"""A written postings index, and lexical search that reads only the blocks which may hold a query's best documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.sources.written import spool

K1, B = 1.2, 0.75
#: So many terms of a search are sent to the tasks at most; more are met by a join.
SENT = 200_000
#: More than rounding to six digits and the order of a sum move a score by.
ROOM = 1e-5


@dataclass(frozen=True)
class PostingsIndex:
    """Tables under ``path``: ``postings`` (part, term, range, count, most_tf, least_n, first, offsets, tf, n), ``added``
    (docs, words) for each addition, and ``ranges`` (grade, ranges) as they were at the beginning.

    A document's range comes from its id and the grade of its length alone, so a block, one term's postings in one
    range, holds documents of about equal length, and its largest count and least length bound what it can score well.
    """

    spark: SparkSession
    path: str
    parts: int = 64

    @classmethod
    def build(cls, docs: DataFrame, path: str, parts: int = 64, size: int = 1024, only: DataFrame | None = None) -> PostingsIndex:
        """Writes the index of ``docs`` (doc_id, text; ids are whole numbers, not null and each once) in ranges of about
        ``size`` and ``parts`` folders of terms, of which a search reads those of its terms. ``only`` (term): a search's
        own terms, where the index serves no other."""
        index = cls(docs.sparkSession, path.rstrip("/"), parts)
        few = None if only is None else only.select("term").distinct().limit(SENT + 1).toPandas()["term"]
        counted = spool(counted_terms(docs, few if few is not None and len(few) <= SENT else None), "counted-terms")
        grades = counted.groupBy(_grade(F.col("n")).alias("grade")).agg(F.ceil(F.count("*") / size).cast("int").alias("ranges"))
        grades.write.parquet(f"{index.path}/ranges")
        index._append(counted, only)
        return index

    def add(self, docs: DataFrame) -> None:
        """Adds documents that the index does not have: new blocks of their own terms; those that stand are not touched."""
        self._append(spool(counted_terms(docs), "counted-terms"), None)

    def _append(self, counted: DataFrame, only: DataFrame | None) -> None:
        grades = self.spark.read.parquet(f"{self.path}/ranges")  # a row for each power of two
        grade = _grade(F.col("n"))
        ranged = counted.withColumn("grade", grade).join(F.broadcast(grades), "grade", "left")
        at = F.pmod(F.xxhash64("doc_id"), F.coalesce("ranges", F.lit(1))).cast("long")
        rows = ranged.select("doc_id", "n", (F.col("grade") * (1 << 40) + at).alias("range"), F.inline(F.arrays_zip("terms", "tf")).alias("term", "tf"))
        if only is not None:
            rows = rows.join(only.select("term").distinct(), "term", "left_semi")
        block = rows.groupBy("term", "range").agg(
            F.sort_array(F.collect_list(F.struct("doc_id", "tf", "n"))).alias("rows"), F.max("tf").alias("most_tf"), F.min("n").alias("least_n")
        )
        first = F.col("rows")[0]["doc_id"]
        block = block.select(
            self.part_of(F.col("term")).alias("part"), "term", "range", F.size("rows").alias("count"), "most_tf", "least_n", first.alias("first"),
            F.transform("rows", lambda r: r["doc_id"] - first).alias("offsets"), F.col("rows.tf").alias("tf"), F.col("rows.n").alias("n"),
        )
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.parts)  # of a folder, so no term is one task's
        dealt = block.repartition("part", F.pmod(F.xxhash64("range"), F.lit(tasks)))
        dealt.sortWithinPartitions("part", "term", "range").write.mode("append").partitionBy("part").parquet(f"{self.path}/postings")
        counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).write.mode("append").parquet(f"{self.path}/added")

    def part_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def _heads(self, asked: DataFrame) -> DataFrame:
        """Blocks of the folders of ``asked``'s terms; the columns that a plan takes from it are all that is read."""
        parts = [r.part for r in asked.select(self.part_of(F.col("term")).alias("part")).distinct().collect()]  # few
        schema = "term string, range bigint, count int, most_tf int, least_n bigint, first bigint, offsets array<bigint>, tf array<int>, n array<bigint>, part int"
        if not parts or not self._written():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("part").isin(parts))

    def _written(self) -> bool:
        """Whether any block is: an index without words, or without a search's words, has no folder of them."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings")
        return any(f.isDirectory() for f in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p))

    def _candidates(self, asked: DataFrame, mean: float, docs: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, term, idf) and, of each query and range, what its documents can score at most."""
        heads = self._heads(asked)
        found = asked.select("term").distinct()
        blocks = spool(heads.select("part", "term", "range", "count", "most_tf", "least_n").join(found, "term"), "block-heads")
        df = blocks.groupBy("term").agg(F.sum("count").alias("df"))
        idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = spool(asked.join(df, "term").select("query_id", "term", idf.alias("idf")), "weighed-terms")
        bound = blocks.groupBy("term", "range").agg(F.max(saturated(F.col("most_tf"), F.col("least_n"), mean)).alias("most"))
        limits = weighed.join(bound, "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("limit"))
        return weighed, limits

    def _scored(self, weighed: DataFrame, ranges: DataFrame, mean: float) -> DataFrame:
        """query_id, doc_id, score of all documents of these (query_id, range) that share a term with the query."""
        wanted = ranges.select("query_id", "range").join(weighed, "query_id").select("query_id", "term", "range", "idf")
        heads = self._heads(weighed).select("part", "term", "range", "first", "offsets", "tf", "n")
        met = wanted.withColumn("part", self.part_of(F.col("term"))).join(heads, ["part", "term", "range"])
        hits = met.select("query_id", "idf", "first", F.inline(F.arrays_zip("offsets", "tf", "n")))
        part = F.col("idf") * saturated(F.col("tf"), F.col("n"), mean)
        return hits.groupBy("query_id", (F.col("first") + F.col("offsets")).alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))

    def search(self, asked: DataFrame, k: int, first: int = 2) -> DataFrame:
        """query_id, doc_id, score, rank of the ``k`` best documents of each query's distinct terms ``asked`` (query_id,
        term); ties go to the smaller id.

        The ``first`` ranges that can score most are scored at once; the k-th best of these is a score to reach, and
        of the other ranges only those that can reach it are read.
        """
        weighed, early, late, mean = self._waves(asked, k, first)
        if weighed is None:
            return self.spark.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int")
        best = early.unionByName(_top(self._scored(weighed, late, mean), k))
        return _top(best, k, "rank").select("query_id", "doc_id", "score", "rank")

    def _waves(self, asked: DataFrame, k: int, first: int):
        total = self.spark.read.parquet(f"{self.path}/added").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        if not total.docs or not total.words:
            return None, None, None, 0.0
        mean = total.words / total.docs
        weighed, limits = self._candidates(asked.select("query_id", "term"), mean, total.docs)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("limit"), "range"))
        ordered = spool(limits.withColumn("nth", nth), "ordered-ranges")
        early = spool(_top(self._scored(weighed, ordered.where(F.col("nth") <= first), mean), k), "first-scores")
        floor = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        late = ordered.where(F.col("nth") > first).join(floor, "query_id", "left")
        return weighed, early, late.where(F.col("floor").isNull() | (F.col("limit") >= F.col("floor") - ROOM)), mean

    def read_share(self, asked: DataFrame, k: int, first: int = 2) -> float:
        """The share of (query, range) pairs with a common term whose postings a search reads."""
        weighed, _, late, mean = self._waves(asked, k, first)
        if weighed is None:
            return 0.0
        limits = self._candidates(asked, mean, 1)[1]
        per_query = limits.groupBy("query_id").count()
        read = per_query.agg(F.sum(F.least("count", F.lit(first)))).first()[0] or 0
        return (read + late.count()) / max(1, limits.count())


def _grade(n: Column) -> Column:
    """Two grades for each power of two of a length."""
    return F.floor(2 * F.log2(n + 1.0)).cast("long")


def saturated(tf: Column, n: Column, mean: float) -> Column:
    """What a term's count weighs in a document of ``n`` words: more with the count, less with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.lit(mean)))


def saturation(tf: np.ndarray, n: np.ndarray, mean: float) -> np.ndarray:
    """``saturated`` over arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def _top(df: DataFrame, k: int, name: str = "nth_") -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col(name) <= k)
    return ranked if name == "rank" else ranked.drop(name)


def counted_terms(docs: DataFrame, only: Sequence[str] | None = None, places: bool = False) -> DataFrame:
    """doc_id, n (tokens), terms and tf of each document; null texts have none. A batch's tokens are counted where they
    are; of ``only`` these terms, if given, but n counts all. ``places``: terms by their place among the sorted ``only``,
    and n is null for a null text."""
    spark = docs.sparkSession
    sent = None if only is None else spark.sparkContext.broadcast(pa.array(sorted(only), pa.string()))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)
            if sent is None:
                coded = lists.flatten().dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                names, code = sent.value, pc.fill_null(pc.index_in(lists.flatten(), sent.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, code = row[code >= 0], code[code >= 0]
            many = max(1, len(names))
            key, n = np.unique(row * many + code, return_counts=True)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(key // many, minlength=b.num_rows))]).astype(np.int32))
            terms = pa.ListArray.from_arrays(at, pa.array((key % many).astype(np.int32)) if places else names.take(pa.array(key % many)))
            total = pa.array(size, mask=lists.is_null().to_numpy(zero_copy_only=False)) if places else pa.array(size)
            yield pa.RecordBatch.from_arrays([b.column(0), total, terms, pa.ListArray.from_arrays(at, pa.array(n.astype(np.int32)))], ["doc_id", "n", "terms", "tf"])

    return words.mapInArrow(count, f"doc_id bigint, n bigint, terms array<{'int' if places else 'string'}>, tf array<int>")
