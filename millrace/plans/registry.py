"""All queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import answers, ingest
from millrace.plans import oracles as first_oracles
from millrace.plans import queries as first

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return first.QUERIES | ingest.QUERIES | answers.QUERIES


def oracles() -> dict[str, str]:
    return first_oracles.ORACLES | ingest.ORACLES | answers.ORACLES
