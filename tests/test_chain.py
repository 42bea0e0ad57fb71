"""Cleaning, linking, derived columns and the order roll-up on a small chain."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frames import chain, one, orders, rows
from ledgerline.operators import cleaning, linking, milestones, rollup
from ledgerline.plans import batch


@pytest.fixture(scope="module")
def cleaned(spark):
    return cleaning.clean_all(chain(spark))


@pytest.fixture(scope="module")
def items(cleaned):
    return milestones.with_milestones(linking.unified_items(cleaned)).cache()


def by_key(items):
    return {(r["sales_order_id"], r["sales_order_item_norm"], r["delivery_id"]): r for r in rows(items)}


def test_clean_types_and_missing_fields(cleaned):
    headers = {r["sales_order_id"]: r for r in rows(cleaned["order_headers"])}
    assert headers["1"]["order_total_net_amount"] == 100.5
    assert headers["2"]["order_total_net_amount"] is None
    assert headers["1"]["order_created_date"] == datetime(2025, 1, 1)
    assert headers["1"]["requested_delivery_date"] is None
    assert headers["1"]["currency"] is None
    assert [f.simpleString() for f in cleaned["billing_headers"].schema][2] == "billing_date:timestamp_ntz"


def test_product_texts_keep_first_language(cleaned):
    assert {r["material_id"]: r["material_desc"] for r in rows(cleaned["product_texts"])} == {"M1": "screw", "M2": "bolt"}


def test_product_texts_of_odd_sources(spark):
    raw = spark.createDataFrame([("M1", "b"), ("M1", "a")], "product string, productDescription string")
    assert [tuple(r) for r in cleaning.product_texts(raw).collect()] == [("M1", "a")]
    assert cleaning.product_texts(raw.drop("product")).collect() == []
    assert cleaning.product_texts(raw.drop("productDescription")).collect() == []
    items = spark.createDataFrame([("M1",), ("M9",)], "material_id string")
    texts = cleaning.product_texts(raw)
    assert {tuple(r) for r in linking.with_product_texts(items, texts).collect()} == {("M1", "a"), ("M9", None)}
    assert {tuple(r) for r in linking.with_product_texts(items, texts.limit(0)).collect()} == {("M1", ""), ("M9", "")}


def test_billing_per_delivery(cleaned, spark):
    got = {r["delivery_id"]: r for r in rows(linking.billing_per_delivery(cleaned["billing_items"]))}
    assert set(got) == {"D1", "D3", "D4"}
    assert got["D1"]["billing_doc_id"] == "B1"
    assert (got["D1"]["billed_qty"], got["D1"]["billed_amount_sum"]) == (4.0, 109.5)
    ordered = spark.createDataFrame(
        [("B1", "D1", 2), ("B2", "D1", 1), (None, "D1", 0)], "billing_doc_id string, delivery_id string, n int"
    ).withColumns({"billed_qty": F.lit(None).cast("double"), "billed_amount": F.lit(None).cast("double")})
    first = one(linking.billing_per_delivery(ordered, "n"))
    assert (first.billing_doc_id, first.billed_amount_sum) == ("B2", 0.0)


def test_payments_per_document(cleaned):
    paid = one(linking.payments_per_document(cleaned["payments"]))
    assert paid.accounting_document == "A1"
    assert paid.payment_posting_date == datetime(2025, 2, 5)
    assert paid.total_amount_paid == 100.5


def test_split_delivery_fans_out_and_null_keys_match_nothing(items):
    got = by_key(items)
    assert set(got) == {
        ("1", "10", "D1"), ("1", "10", "D2"), ("1", "20", "D1"), ("2", "10", "D3"),
        ("2", "20", "D4"), ("3", "10", "D5"), ("4", "10", None), (None, "10", None),
    }
    assert got[(None, "10", None)]["customer_id"] is None
    assert got[("4", "10", None)]["customer_id"] is None
    assert got[("1", "10", "D1")]["customer_name"] == "Ann, Bo and Co"
    assert got[("3", "10", "D5")]["material_desc"] is None


def test_item_first_chain_gives_the_same_rows(cleaned, items):
    t = cleaned
    steps = linking.with_headers(t["order_items"], t["order_headers"])
    steps = linking.with_deliveries(steps, t["delivery_items"])
    steps = linking.with_delivery_headers(steps, t["delivery_headers"])
    steps = linking.with_billing(steps, linking.billing_per_delivery(t["billing_items"]))
    steps = linking.with_billing_headers(steps, t["billing_headers"])
    steps = linking.with_payments(steps, linking.payments_per_document(t["payments"]))
    steps = linking.with_product_texts(linking.with_partners(steps, t["partners"]), t["product_texts"])
    direct = steps.select(*linking.ITEM_COLUMNS)
    composed = items.select(*linking.ITEM_COLUMNS)
    assert direct.exceptAll(composed).count() == 0
    assert composed.exceptAll(direct).count() == 0


def test_derived_columns(items):
    got = by_key(items)
    late = got[("1", "10", "D1")]
    assert (late["order_to_delivery_days"], late["billing_to_payment_days"], late["total_o2c_days"]) == (3, 31, 35)
    assert (late["is_delivery_delayed"], late["is_payment_overdue"], late["lifecycle_stage"]) == (False, True, "paid")
    assert late["issue_severity"] == 1
    split = got[("1", "10", "D2")]
    assert (split["is_delivery_delayed"], split["missing_stage"], split["lifecycle_stage"]) == (True, True, "delivered")
    assert split["issue_severity"] == 2
    cancelled = got[("2", "10", "D3")]
    assert cancelled["delivery_to_billing_days"] == -1
    assert (cancelled["lifecycle_stage"], cancelled["is_billing_cancelled"], cancelled["is_unpaid"]) == ("cancelled", True, False)
    unknown = got[("2", "20", "D4")]
    assert (unknown["is_cancelled"], unknown["is_unpaid"], unknown["lifecycle_stage"]) == (None, True, "billed")
    assert unknown["order_to_delivery_days"] is None and unknown["is_delivery_delayed"] is False
    bare = got[("4", "10", None)]
    assert (bare["lifecycle_stage"], bare["missing_stage"], bare["expected_payment_days"]) == ("ordered", True, 30)
    assert got[("1", "20", "D1")]["is_rejected"] and not got[("2", "10", "D3")]["is_rejected"]
    assert cancelled["has_delivery_block"] and not got[("3", "10", "D5")]["has_delivery_block"]


@pytest.mark.parametrize("paid_on,overdue", [("2025-02-04", False), ("2025-02-05", True)])
def test_overdue_starts_after_the_term_day(spark, paid_on, overdue):
    df = spark.createDataFrame([("2025-01-05", paid_on, "Z001")], "b string, p string, payment_terms string").select(
        F.col("b").cast("timestamp_ntz").alias("billing_date"),
        F.col("p").cast("timestamp_ntz").alias("payment_posting_date"),
        F.lit(None).cast("timestamp_ntz").alias("order_created_date"),
        F.lit(None).cast("timestamp_ntz").alias("delivery_created_date"),
        "payment_terms",
    )
    assert one(milestones.payment_overdue(milestones.cycle_times(df))).is_payment_overdue is overdue


@pytest.mark.parametrize("days,delayed", [(3, False), (4, True), (None, False)])
def test_delay_is_strictly_more_than_allowed(spark, days, delayed):
    df = spark.createDataFrame([(days,)], "order_to_delivery_days bigint")
    assert one(milestones.delivery_delayed(df)).is_delivery_delayed is delayed


def test_order_view(items):
    got = {r["sales_order_id"]: r for r in rows(rollup.order_view(items))}
    assert set(got) == {"1", "2", "3", "4"}
    first = got["1"]
    assert first["total_items"] == 3
    assert first["lifecycle_stage"] == "paid"
    # A delivery's billing and a document's payment count once per item.
    assert (first["total_billed_amount"], first["total_paid_amount"]) == (219.0, 201.0)
    assert first["revenue_leakage_amount"] == pytest.approx(-100.5)
    assert first["max_issue_severity"] == 2
    assert first["order_to_delivery_days"] == 3
    tie = got["2"]  # billed and cancelled once each
    assert tie["lifecycle_stage"] == "billed"
    assert tie["order_total_net_amount"] is None and tie["revenue_leakage_amount"] is None
    assert (tie["is_unpaid"], tie["is_billing_cancelled"]) == (True, True)
    assert got["4"]["customer_id"] is None and got["4"]["total_billed_amount"] == 0.0


def test_order_view_settles_conflicting_headers(items):
    twice = items.filter("sales_order_id = '1'").withColumn(
        "payment_terms", F.when(F.col("sales_order_item") == "20", "Z000").otherwise(F.col("payment_terms"))
    )
    order = one(rollup.order_view(twice))
    assert (order.payment_terms, order.total_items, order.total_billed_amount) == ("Z000", 3, 219.0)


def test_most_frequent_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame(
        [("a", "y"), ("a", "x"), ("a", None), ("a", None), ("b", "z"), ("b", "z"), ("b", "c")], "k string, v string"
    )
    assert {r["k"]: r["v"] for r in rows(rollup.most_frequent(df, ["k"], "v"))} == {"a": "x", "b": "z"}


def test_written_tables_equal_the_lazy_plan(spark, tmp_path):
    raw = chain(spark)
    written, lazy = batch.build(raw, str(tmp_path / "serving")), batch.plan(raw)
    for name in ("items", "orders", "customers"):
        a, b = getattr(written, name), getattr(lazy, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    drop = ["generated_at"]
    assert rows(written.document.drop(*drop)) == rows(lazy.document.drop(*drop))
