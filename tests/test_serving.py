"""KPIs, filters, pages, issues, graph and payloads over order rows."""

import json

import pytest
from pyspark.sql import functions as F

from frames import one, orders, rows
from ledgerline.operators import docgraph, issues, kpis, payloads, serving
from ledgerline.sources import readers, sinks


@pytest.fixture(scope="module")
def some(spark):
    return orders(
        spark,
        [
            dict(sales_order_id="1", customer_id="7", customer_name="A", lifecycle_stage="paid", total_o2c_days=4,
                 order_to_delivery_days=1, order_total_net_amount=100.0, total_paid_amount=40.0, total_items=2),
            dict(sales_order_id="2", customer_id="7", customer_name="A", lifecycle_stage="cancelled", total_o2c_days=5,
                 order_to_delivery_days=6, is_billing_cancelled=True, is_delivery_delayed=True, max_issue_severity=2,
                 order_total_net_amount=50.0),
            dict(sales_order_id="3", customer_id="8", customer_name="B", is_unpaid=True, lifecycle_stage="billed",
                 max_issue_severity=1, order_total_net_amount=10.0),
            dict(sales_order_id="4", customer_id=None, missing_stage=True, max_issue_severity=None, is_payment_overdue=True),
            dict(sales_order_id="5", customer_id="8", customer_name="B", is_payment_overdue=True, max_issue_severity=1,
                 lifecycle_stage="paid", order_total_net_amount=5.0, total_paid_amount=5.0),
        ],
    ).cache()


def ids(df):
    return [r.sales_order_id for r in df.collect()]


def test_filters(some):
    pick = serving.select_orders
    assert ids(pick(some, customer=7)) == ["1", "2"]
    assert ids(pick(some, stage="nowhere")) == []
    assert ids(pick(some, min_severity=1)) == ["2", "3", "5"]
    assert ids(pick(some, issue_type="missing")) == ["4"]
    assert len(ids(pick(some, issue_type="strange"))) == 5
    assert len(ids(pick(some, customer="", stage=None, min_severity=0))) == 5
    assert ids(pick(some, customer="7", stage="cancelled", min_severity=2, issue_type="delayed")) == ["2"]
    assert ids(some.filter(serving.needs_attention())) == ["2", "3", "5"]


def test_sort_puts_nulls_last_both_ways(some):
    assert ids(serving.sort_orders(some, "total_o2c_days", "asc")) == ["1", "2", "3", "4", "5"]
    assert ids(serving.sort_orders(some, "total_o2c_days", "desc")) == ["2", "1", "3", "4", "5"]
    assert ids(serving.sort_orders(some, "total_o2c_days", "sideways")) == ["2", "1", "3", "4", "5"]
    assert ids(serving.sort_orders(some, "no_column", "desc")) == ["1", "2", "3", "4", "5"]


def test_pages_do_not_overlap_and_know_the_total(some):
    first = serving.list_orders(some, sort_by="sales_order_id", sort_dir="asc", limit=2).collect()
    second = serving.list_orders(some, sort_by="sales_order_id", sort_dir="asc", limit=2, offset=2).collect()
    assert [r.sales_order_id for r in first + second] == ["1", "2", "3", "4"]
    assert {r.total for r in first + second} == {5}
    assert serving.list_orders(some, stage="nowhere").count() == 0


def test_lookups(some):
    assert one(serving.order_by_id(some, 2)).lifecycle_stage == "cancelled"
    assert serving.order_by_id(some, "nope").count() == 0
    assert [r.order_count for r in serving.customer_orders(some, 8).collect()] == [2, 2]
    assert [r.list_value for r in serving.filter_values(some).filter("list_name = 'stage'").collect()] == [
        "billed", "cancelled", "ordered", "paid",
    ]


def test_issue_lists(some):
    listed = rows(issues.list_issues(some))
    assert [r["sales_order_id"] for r in listed] == ["2", "3", "4"]
    assert listed[0]["issue_labels"] == ["Delivery delayed beyond threshold", "Billing document cancelled"]
    assert listed[2]["issue_labels"] == ["Incomplete lifecycle — missing stage"]
    assert {r["total"] for r in listed} == {3}
    assert ids(issues.list_issues(some, "unpaid")) == ["3"]
    assert ids(issues.list_issues(some, "strange", limit=1, offset=1)) == ["3"]
    assert one(issues.total_flagged(some)).total_flagged == 3
    assert {r["issue_type"]: r["order_count"] for r in rows(issues.counts_by_type(some))} == {
        "delayed": 1, "cancelled": 1, "unpaid": 1, "missing": 1,
    }
    assert [tuple(r) for r in issues.severity_histogram(some).collect()] == [(0, 2), (1, 2), (2, 1)]


def test_customer_kpis(some):
    first, second = kpis.customer_kpis(some).collect()
    assert (first.customer_id, first.risk_score, first.avg_o2c_days, first.total_revenue_inr) == ("7", 2, 4.5, 150.0)
    assert (second.customer_id, second.risk_score, second.avg_o2c_days, second.overdue_orders) == ("8", 2, None, 1)


def test_filtered_kpis(some):
    got = one(kpis.filtered_kpis(some, customer="7"))
    assert (got.total_orders, got.total_order_items, got.total_paid_inr) == (2, 3, 40.0)
    assert (got.revenue_leakage_inr, got.payment_coverage_pct) == (110.0, 26.7)
    assert (got.median_order_to_delivery_days, got.cancellation_rate_pct) == (3.5, 50.0)
    empty = one(kpis.filtered_kpis(some, stage="nowhere"))
    assert (empty.total_orders, empty.payment_coverage_pct, empty.cancellation_rate_pct) == (0, 0.0, None)
    document = one(kpis.filtered_document(some, stage="paid"))
    assert document.filters.stage == "paid" and document.lifecycle_stages == {"paid": 2}


def test_documents_count_once(spark):
    items = spark.createDataFrame(
        [("B1", 10.0, "A1", 4.0), ("B1", 10.0, "A1", 4.0), ("B2", 5.0, None, None), (None, None, None, None)],
        "billing_doc_id string, billing_amount double, accounting_document string, total_amount_paid double",
    )
    head = orders(spark, [dict(customer_id="1", order_total_net_amount=20.0), dict(customer_id="1"), dict()])
    got = one(kpis.overview(items, head))
    assert (got.total_orders, got.total_order_items, got.unique_customers) == (3, 4, 1)
    assert (got.total_billed_inr, got.total_paid_inr, got.revenue_leakage_inr) == (15.0, 4.0, 16.0)
    assert (got.billing_coverage_pct, got.payment_coverage_pct) == (75.0, 20.0)
    due = one(kpis.days_sales_outstanding(items, head, days=100))
    assert (due.receivable_inr, due.dso_days) == (11.0, 55.0)
    nothing = one(kpis.overview(items.limit(0), head.limit(0)))
    assert (nothing.total_revenue_inr, nothing.billing_coverage_pct) == (0.0, 0.0)


def test_order_context_has_one_grain(spark):
    """An order of 5000 items gives the same kind of rows as one of one item."""
    head = orders(spark, [dict(sales_order_id="1", total_items=5000), dict(sales_order_id="2"), dict(sales_order_id="3", total_items=0)])
    items = spark.range(5000).select(F.lit("1").alias("sales_order_id"), F.col("id").cast("string").alias("sales_order_item"))
    items = items.unionByName(spark.sql("select '2' as sales_order_id, '10' as sales_order_item"))
    rows = serving.order_context(head, items).collect()
    assert sorted(int(r.item.sales_order_item) for r in rows if r.sales_order_id == "1") == list(range(5000))
    assert [r.item.sales_order_item for r in rows if r.sales_order_id == "2"] == ["10"]
    assert [r.item for r in rows if r.sales_order_id == "3"] == [None]
    assert {r.order.sales_order_id for r in rows} == {"1", "2", "3"}
    (nested,) = serving.order_document(head, items, 1).collect()
    assert len(nested["items"]) == 5000 and nested.total_items == 5000
    assert [r["items"] for r in serving.order_document(head, items, 3).collect()] == [[]]


def test_payloads(spark):
    head = orders(spark, [dict(sales_order_id="1", lifecycle_stage="paid"), dict(sales_order_id="9")])
    items = spark.sql("select '1' as sales_order_id, '10' as sales_order_item, cast(null as string) as delivery_id")
    texts = {r.sales_order_id: json.loads(r.payload) for r in payloads.order_payloads(head, items).collect()}
    assert texts["1"]["order"]["lifecycle_stage"] == "paid"
    assert texts["1"]["item"] == {"sales_order_id": "1", "sales_order_item": "10", "delivery_id": None}
    assert texts["9"]["item"] is None


def test_pages_out_of_range(spark):
    head = orders(spark, [dict(sales_order_id="1")])
    for limit, offset in ((0, 0), (501, 0), (10, -1)):
        with pytest.raises(ValueError):
            serving.list_orders(head, limit=limit, offset=offset)
    assert serving.list_orders(head, limit=500).count() == 1


def test_graph(spark):
    items = spark.createDataFrame(
        [("1", "D1", "B1", "A1"), ("1", "D1", "B1", "A1"), ("2", "D2", None, None), ("3", None, None, None)],
        "sales_order_id string, delivery_id string, billing_doc_id string, accounting_document string",
    )
    journal = spark.createDataFrame([("A1", "1"), ("A1", "2"), ("A9", "1")], "accountingDocument string, accountingDocumentItem string")
    links = docgraph.edges(items, journal)
    got = {(r.sales_order_id, r.src_id, r.dst_id) for r in links.collect()}
    assert links.count() == len(got)
    assert got == {("1", "1", "D1"), ("1", "D1", "B1"), ("1", "B1", "A1"), ("1", "A1", "A1/1"), ("1", "A1", "A1/2"), ("2", "2", "D2")}
    found = docgraph.nodes(items, journal)
    assert found.count() == found.distinct().count() == 9
    assert [r.node_id for r in docgraph.of_order(found, 3).collect()] == ["3"]
    assert docgraph.of_order(links, 3).isEmpty()
    flags = spark.createDataFrame([(False, False, False), (True, False, False), (True, True, False), (True, True, True)],
                                  "has_delivery boolean, has_billing boolean, has_payment boolean")
    assert [r.break_point for r in docgraph.chain_breaks(flags).collect()] == ["delivery", "billing", "payment", None]


def test_upsert_and_publish(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, None)], "id string, n int, t string")
    path = str(tmp_path / "v2")
    sinks.publish(old, new, "id", path)
    got = {r.id: (r.n, r.t) for r in spark.read.parquet(path).collect()}
    assert got == {"a": (1, "x"), "b": (None, "z"), "c": (3, None)}
    # rows without a key stay in both snapshots; several updates of a key leave the highest version
    more = spark.createDataFrame([("a", 5, "five"), ("a", 7, "seven"), ("a", 6, "six"), (None, 1, "k")], "id string, n int, t string")
    for current, name in ((None, "first"), (spark.read.parquet(path).unionByName(more.filter("id is null")), "next")):
        sinks.publish(current, more, "id", str(tmp_path / name), ["n"])
        rows_ = [tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()]
        assert [r for r in rows_ if r[0] == "a"] == [("a", 7, "seven")]
        assert rows_.count((None, 1, "k")) == (1 if current is None else 2)


def test_latest_and_log(spark, tmp_path):
    log = str(tmp_path / "log")
    for n in range(3):
        sinks.append_log(spark.createDataFrame([(n, f"q{n}")], "id int, question string"), log)
    entries = spark.read.parquet(log)
    assert [r.id for r in sinks.recent(entries, "created_at", "id", 2).collect()] == [2, 1]
    versions = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), (None, 9, "r")], "k string, v int, t string")
    assert [tuple(r) for r in sinks.latest_per_key(versions, "k", ["v"]).collect()] == [("a", 2, "q")]


def test_health(some):
    assert tuple(one(readers.dataset_health(some))) == (True, 5)
    assert tuple(one(readers.dataset_health(some.limit(0)))) == (False, 0)
