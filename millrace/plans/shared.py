"""What several queries of a session use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.operators.postings import PostingsIndex
from millrace.sources.tables import corpus
from millrace.sources.written import folder

_indexes: dict[tuple[str, str], PostingsIndex] = {}


def corpus_index(spark: SparkSession, sf: str) -> PostingsIndex:
    """The postings index of all documents: written by the first query of a session that asks for it, read by the others."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = PostingsIndex.build(corpus(spark, sf), folder(spark, "corpus-postings"))
    return _indexes[key]
