"""Every registered query against its SQL on an independent engine."""

import math
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from conftest import TESTDATA
from ledgerline.plans import queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# the training-data queries have tests of their own
QUERIES = {name: q for name, q in entry_module.queries().items() if name in queries.QUERIES}
ORACLES = queries.ORACLES


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/{name}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def comparable(arrow):
    df = arrow.to_pandas(integer_object_nulls=True).astype(object)
    names = sorted(df.columns)
    return names, sorted(tuple(map(cell, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    got = QUERIES[name](spark, TESTDATA).toArrow()
    expected = engine.sql(ORACLES[name]).to_arrow_table()
    assert comparable(got) == comparable(expected)


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(ORACLES) == set(QUERIES)


def test_queries_leave_the_session_alone(spark):
    before = dict(spark.conf.getAll)
    entry_module.entry(spark)
    for name in ("order_view", "order_context", "scan_jsonl"):
        QUERIES[name](spark, TESTDATA)
    assert dict(spark.conf.getAll) == before


def test_document_scans_items_once(spark):
    plan = QUERIES["kpi_document_flat"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*billing_doc_id", plan)) == 1


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "customer_id" and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_the_engine(spark, name):
    """No Python in the plan, no product of two tables, no window over a whole table."""
    plan = QUERIES[name](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert word not in plan


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("order_lookup", "EqualTo(sales_order_id,7)"),
        ("orders_by_stage", "EqualTo(lifecycle_stage,cancelled)"),
        ("orders_by_customer", "EqualTo(customer_id,42)"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    plan = QUERIES[name](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan


def test_scans_read_only_what_is_used(spark):
    plan = QUERIES["sum_once_per_document"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<billing_doc_id:string,billing_amount:double>" in plan
