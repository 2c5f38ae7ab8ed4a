"""All queries of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import corpus, documents, records, retrieval, texts  # noqa: F401  (they register their queries)
from folioflow.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Abstract search with one hit for each document."""
    return retrieval.v4_search_abstracts(spark, root)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
