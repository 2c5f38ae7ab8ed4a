"""Every query of the subpackage runs and equals its SQL where it has one."""

import pytest

from folioflow.llm import queries as Q
from tests.compare import rows_of, rows_of_sql

COLUMNS = {"p1_found": ["id_a", "id_b"], "p2_found": ["id"], "p3_found": ["cluster_id", "id"], "p4_found": ["id", "noise"], "p5_found": ["defect", "id"], "p6_found": ["doc_id", "spec_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    cols, rows = rows_of(Q.queries()[name](spark, data))
    assert cols == COLUMNS.get(name, cols)
    if name in COLUMNS:
        assert len(rows) == len(set(rows))
    if name in Q.oracle_sql():
        assert (cols, rows) == rows_of_sql(Q.oracle_sql()[name], data)
