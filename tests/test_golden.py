"""Published results recomputed from the published order table.

Set LEDGERLINE_GOLDEN to a folder with the processed order CSV, customer list
and KPI document of the original data set; without it these tests are skipped.
"""

import glob
import os

import pytest

from frames import one, rows
from ledgerline.operators import issues, kpis, serving
from ledgerline.sources import readers
from ledgerline.sources.catalog import CUSTOMER_KPI_DDL, KPI_DOCUMENT_DDL, ORDER_COLUMNS_DDL

FOLDER = os.environ.get("LEDGERLINE_GOLDEN", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="LEDGERLINE_GOLDEN is not set")


def file(part):
    (path,) = glob.glob(f"{FOLDER}/*{part}*")
    return path


@pytest.fixture(scope="module")
def orders(spark):
    return readers.read_processed_csv(spark, file("orders"), ORDER_COLUMNS_DDL).cache()


@pytest.fixture(scope="module")
def document(spark):
    return one(readers.read_json_document(spark, file("kpi_summary"), KPI_DOCUMENT_DDL))


def test_customers(spark, orders):
    expected = rows(readers.read_json_document(spark, file("customer_kpis"), CUSTOMER_KPI_DDL))
    got = rows(kpis.customer_kpis(orders))
    assert sorted(got, key=lambda r: r["customer_id"]) == sorted(expected, key=lambda r: r["customer_id"])
    assert [r["risk_score"] for r in got] == [r["risk_score"] for r in expected]


def test_document_blocks(orders, document):
    assert one(kpis.cycle_time_stats(orders)).asDict() == document.cycle_times.asDict()
    assert one(kpis.issue_rates(orders)).asDict() == document.issues.asDict()
    assert one(kpis.stage_map(orders)).lifecycle_stages == document.lifecycle_stages
    whole = one(kpis.filtered_kpis(orders))
    overview = document.overview
    assert (whole.total_orders, whole.total_order_items, whole.unique_customers, whole.total_revenue_inr) == (
        overview.total_orders, overview.total_order_items, overview.unique_customers, overview.total_revenue_inr,
    )


def test_requests(orders):
    assert one(kpis.filtered_kpis(orders, stage="cancelled")).total_orders == 56
    assert one(kpis.filtered_kpis(orders, customer="320000083")).total_orders == 72
    assert one(serving.order_by_id(orders, "740539")).lifecycle_stage == "paid"
    assert one(serving.order_by_id(orders, "740509")).lifecycle_stage == "cancelled"
    assert one(serving.order_by_id(orders, "740584")).missing_stage
    assert serving.list_orders(orders, stage="nowhere").count() == 0
    assert {r.total for r in serving.list_orders(orders, limit=10).collect()} == {100}


def test_issue_summary(orders):
    assert {r.issue_type: r.order_count for r in issues.counts_by_type(orders).collect()} == {
        "cancelled": 56, "unpaid": 22, "missing": 17, "delayed": 9,
    }
    assert one(issues.total_flagged(orders)).total_flagged == 96
    assert [tuple(r) for r in issues.severity_histogram(orders).collect()] == [(0, 4), (1, 88), (2, 8)]


def test_order_page_starts_with_the_latest(orders):
    page = serving.list_orders(orders, limit=100).collect()
    dates = [r.order_created_date for r in page]
    assert dates == sorted(dates, reverse=True) and len(page) == 100
