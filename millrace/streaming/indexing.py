"""An indexing job over a stream of documents: each batch is one commit of documents and chunks, a batch that comes twice
changes nothing, and a document's status says what really became of its chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType

from millrace.operators.calls import Model, with_vectors
from millrace.sources.commits import Change, Store
from millrace.sources.written import discard, spool

#: (doc_id, text) to the chunks of these documents: (doc_id, position, text).
Cut = Callable[[DataFrame], DataFrame]


def _newest(batch: DataFrame, order: str) -> DataFrame:
    """The last row of each document in a batch, ties by the larger text; rows without an id belong to no document."""
    last = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.col(order), F.col("text"))).alias("last"))
    return last.select("doc_id", F.col("last.text").alias("text"), F.sha2(F.coalesce("last.text", F.lit("")), 256).alias("hash"))


def index_documents(change: Change, batch: DataFrame, order: str, cut: Cut, model: Model, tasks: int | None = None) -> None:
    """Brings the tables ``documents`` and ``chunks`` of a store up to a batch of (doc_id, ``order``, text).

    * A document whose text is the one that is indexed stays as it is; one that failed or is partial is tried again.
    * A chunk whose text its document already had keeps its vector; only other texts go to the model, once a document.
    * Status: ``indexed``; ``failed`` without chunks, or if no chunk has a vector; ``partial`` if a new document lacks
      some. A document that has chunks keeps them all, and is ``failed``, if any new text gets no vector.
    """
    newest = docs = spool(_newest(batch, order), "index_docs")
    known = "documents" in change.names()
    if known:
        same = change.read("documents").where("status = 'indexed'").select("doc_id", "hash")
        docs = docs.join(same, ["doc_id", "hash"], "left_anti")
    chunks = spool(cut(docs.select("doc_id", "text")).withColumn("chunk_hash", F.md5("text")), "index_chunks")
    texts = chunks.groupBy("doc_id", "chunk_hash").agg(F.first("text").alias("text"))
    if known:
        mine = change.read("chunks").join(docs.select("doc_id"), "doc_id", "left_semi")
        kept = mine.groupBy("doc_id", "chunk_hash").agg(F.first("vector").alias("vector"))
        texts = texts.join(kept, ["doc_id", "chunk_hash"], "left_anti")
    else:
        blank = F.lit(None).cast(ArrayType(DoubleType()))
        kept = chunks.select("doc_id", "chunk_hash", blank.alias("vector")).limit(0)
    made = spool(with_vectors(texts, model, tasks=tasks).select("doc_id", "chunk_hash", "vector", "error"), "index_made")
    every = made.unionByName(kept.withColumn("error", F.lit(None).cast("string")))
    whole = chunks.join(every, ["doc_id", "chunk_hash"])
    n = whole.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count("vector").alias("n_embedded"), F.min("error").alias("error"))
    had = kept.groupBy("doc_id").agg(F.lit(True).alias("had"))
    failed = F.col("n_embedded") < F.col("n_chunks")
    status = (
        F.when(F.col("n_chunks") == 0, "failed").when(~failed, "indexed").when(F.col("had") | (F.col("n_embedded") == 0), "failed").otherwise("partial")
    )
    counted = docs.drop("text").join(n, "doc_id", "left").join(had, "doc_id", "left").withColumn("had", F.coalesce("had", F.lit(False)))
    counted = counted.fillna(0, ["n_chunks", "n_embedded"])
    error = F.when(F.col("n_chunks") == 0, "no chunks").otherwise(F.col("error"))
    rows = spool(counted.select("doc_id", "hash", status.alias("status"), "n_chunks", "n_embedded", error.alias("error")), "index_status")
    replaced = rows.where("status in ('indexed', 'partial')").select("doc_id")
    new = whole.where("vector is not null").join(replaced, "doc_id", "left_semi")
    change.put("documents", rows, ["doc_id"])
    change.put("chunks", new.select("doc_id", "position", "text", "chunk_hash", "vector"), ["doc_id"], gone=replaced)
    for written in (newest, chunks, made, rows):
        discard(written)


def index_stream(
    stream: DataFrame, store: Store, job: str, checkpoint: str, order: str, cut: Cut, model: Model, tasks: int | None = None
) -> StreamingQuery:
    """Indexes all that a stream has now. ``job`` names this stream in the store's commits, with the last batch each holds:
    a batch that was committed before its checkpoint was written is skipped when it comes again. A new checkpoint numbers
    its batches anew, so it needs a new ``job``."""

    def deliver(batch: DataFrame, number: int) -> None:
        store.update(lambda change: index_documents(change, batch, order, cut, model, tasks), job, number)

    query = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
