"""Every query of the core runs, and equals its SQL where it has one."""

import pytest

from folioflow.plans import catalog
from tests.compare import rows_of, rows_of_sql

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Slow for what they show; the driver runs them.
SLOW = {"v9_ivf_recall", "e4_e5_comparison"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, data, name):
    found = rows_of(QUERIES[name](spark, data))
    if name in SQL:
        assert found == rows_of_sql(SQL[name], data)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "chunk_id", "dist"]


def test_recall_of_indexes(spark, data):
    """Inverted cells find nine of ten neighbours when half the cells are probed."""
    from folioflow.operators import vectors
    from folioflow.plans import retrieval

    s = retrieval.store(spark, data).select(vectors.F.col("vec_id").alias("id"), "vectors")
    q = s.filter("id % 20 = 0").select(vectors.F.col("id").alias("query_id"), vectors.F.col("vectors").alias("query"))
    indexed, fitted = vectors.build_ivf(s, 8)
    exact = vectors.search_each(s, q, 10, ("id",))
    assert vectors.recall(vectors.search_ivf(indexed, fitted, q, 10, 5, ("id",)), exact, "id").head()[0] >= 0.9
    assert vectors.recall(vectors.search_ivf(indexed, fitted, q, 10, 8, ("id",)), exact, "id").head()[0] == 1.0
