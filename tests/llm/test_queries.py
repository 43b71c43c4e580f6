"""The registered queries: against their SQL, or as many rows as the table has."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from quire.llm.queries import QUERIES


@pytest.fixture(scope="module")
def database():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, database, name):
    frame = queries()[name](spark, sf_dir)
    assert "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString()
    ours = frame.toPandas()
    if name in oracle_sql():
        assert compare(name, ours, database.sql(oracle_sql()[name]).df()) == ""
    else:
        assert sorted(ours["doc_id"]) == list(range(200))
