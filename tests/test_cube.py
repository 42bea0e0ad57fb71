"""Filtered KPIs out of the cube against the scan of the order table."""

import random
import re

import pytest

from frames import one, orders
from ledgerline.operators import cube, kpis

STAGES = ["paid", "billed", "cancelled", None]


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(4)

    def maybe(value):
        return value if rng.random() < 0.8 else None

    rows = [
        dict(
            sales_order_id=str(i), customer_id=maybe(str(rng.randrange(6) if i % 3 else 0)), lifecycle_stage=rng.choice(STAGES),
            order_total_net_amount=maybe(rng.randrange(10_000) / 100), total_paid_amount=maybe(rng.randrange(9_000) / 100),
            total_items=maybe(rng.randrange(5)), order_to_delivery_days=maybe(rng.randrange(9)), total_o2c_days=maybe(rng.randrange(-2, 80)),
            delivery_to_billing_days=maybe(rng.randrange(4)), billing_to_payment_days=maybe(3), is_delivery_delayed=maybe(i % 5 == 0),
            is_billing_cancelled=maybe(i % 7 == 0), is_unpaid=maybe(i % 2 == 0), missing_stage=maybe(False),
        )
        for i in range(300)
    ]
    return orders(spark, rows).cache()


@pytest.fixture(scope="module")
def written(spark, some, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube"))
    cube.write(cube.build(some), path)
    return cube.open_cube(spark, path)


@pytest.mark.parametrize("customer", [None, "", "0", "3", "nobody"])
@pytest.mark.parametrize("stage", [None, "paid", "billed", "no such stage"])
def test_every_request_equals_the_scan(some, written, customer, stage):
    got, want = one(cube.filtered_kpis(written, customer, stage)), one(kpis.filtered_kpis(some, customer, stage))
    assert got.asDict() == pytest.approx(want.asDict(), abs=0.011, nan_ok=True)
    exact = [c for c in want.asDict() if "median" in c or "orders" in c or "unique" in c or "items" in c]
    assert [got[c] for c in exact] == [want[c] for c in exact]


@pytest.mark.parametrize("customer,stage", [("0", None), (None, "paid"), ("3", "billed"), ("nobody", None)])
def test_documents_equal_the_scan(some, written, customer, stage):
    got = one(cube.summary(None, written, customer, stage))
    want = one(kpis.filtered_document(some, customer, stage))
    assert got.lifecycle_stages == want.lifecycle_stages and got.filters == want.filters
    assert got.issues == want.issues and got.cycle_times == want.cycle_times


def test_request_reads_no_orders(written):
    plan = cube.filtered_kpis(written, "3", None)._jdf.queryExecution().executedPlan().toString()
    assert "order_total_net_amount" not in plan
    assert len(re.findall(r"PartitionFilters: \[[^\]]*level#\d+ = customer\)", plan)) == 2
    assert "EqualTo(customer_id,3)" in plan


def test_orders_are_combined_before_the_grouping_sets(some):
    plan = cube.build(some).cells._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Expand") < plan.index("order_total_net_amount") and plan.count("Expand") == 1


def test_no_orders(spark, some, tmp_path):
    cube.write(cube.build(some.limit(0)), str(tmp_path))
    empty = cube.open_cube(spark, str(tmp_path))
    got = one(cube.filtered_kpis(empty, stage="paid"))
    assert got.asDict() == one(kpis.filtered_kpis(some.limit(0), stage="paid")).asDict()
