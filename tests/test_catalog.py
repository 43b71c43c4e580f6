"""Every query against its SQL on the smallest tables, and the shape of some plans."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from check import compare, connect


@pytest.fixture(scope="module")
def database():
    return connect("/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, database, name):
    frame = QUERIES[name](spark, sf_dir)
    plan = plan_of(frame)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ours = frame.toPandas()
    assert compare(name, ours, database.sql(ORACLES[name]).df()) == ""


def test_entry(spark):
    assert entry(spark).count() == 50


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [
    ("fingerprint", "doc_id,text"), ("format_counts", "url"), ("output_tree", "doc_id,lang,source"),
    ("batch_stats", "doc_id"), ("page_rows", "conv_id,turn,role,text")])
def test_scans_read_only_what_is_needed(spark, sf_dir, name, columns):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, sf_dir))).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == sorted(columns.split(","))


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan_of(QUERIES["page_rows"](spark, sf_dir))
    assert "GreaterThanOrEqual(turn,1)" in text and "LessThanOrEqual(turn,2)" in text
