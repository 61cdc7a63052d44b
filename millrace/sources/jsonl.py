"""Rows of JSON Lines files under a declared schema, with what could not be read beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.json_repair import repaired


def read_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The ``schema``'s columns, status and line of each line that is not blank: ``read`` as it stands, ``mended`` if it can
    be read once it is mended, else ``corrupt`` with null columns. line is kept where a line is not read as it stands.

    A line that is JSON but not an object, or has a value that does not fit the schema, is no row as it stands.
    """
    declared = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    first = lines.select("value", F.from_json("value", declared, options).alias("row"))
    is_object = F.ltrim("value").startswith("{")
    good = F.col("row").isNotNull() & F.col("row._corrupt_record").isNull() & is_object
    kept = first.where(good).select("row.*", F.lit("read").alias("status"), F.lit(None).cast("string").alias("line"))
    rest = first.where(~good | good.isNull()).select("value", F.from_json(repaired(F.col("value")), declared, options).alias("row"))
    fine = F.col("row").isNotNull() & F.col("row._corrupt_record").isNull()
    columns = [F.when(fine, F.col("row").getField(f.name)).alias(f.name) for f in schema.fields]
    mended = rest.select(*columns, F.when(fine, "mended").otherwise("corrupt").alias("status"), F.col("value").alias("line"))
    return kept.drop("_corrupt_record").unionByName(mended)
