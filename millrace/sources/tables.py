"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk sink: appended under one folder for each knowledge base, which filters on kb_id prune to."""
    chunks.write.mode("append").partitionBy("kb_id").parquet(path)


def kb_of(doc: Column) -> Column:
    return F.coalesce(doc, F.lit("none"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the access columns that the tables lack, derived from the id and the source."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "n_chars", F.col("source").alias("kb_id"),
        F.when(d % 3 == 0, "public").when(d % 3 == 1, "internal").otherwise("restricted").alias("visibility"),
        F.array((d % 4).cast("int")).alias("allowed_roles"), (d % 7).alias("owner"),
    )
