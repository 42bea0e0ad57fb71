"""Deep pages out of a directory against pages of the whole order table."""

import random
import re

import pytest

from frames import orders
from ledgerline.operators import directory, issues, serving
from ledgerline.plans import batch


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(8)
    rows = [
        dict(
            sales_order_id=str(i), customer_id=str(i % 5), lifecycle_stage=rng.choice(["paid", "billed", None]),
            order_total_net_amount=None if i % 11 == 0 else float(7 if i % 3 == 0 else rng.randrange(50)),
            max_issue_severity=rng.choice([None, 0, 1, 2, 3]), is_unpaid=rng.choice([True, False, None]),
            is_delivery_delayed=rng.random() < 0.1, is_billing_cancelled=False, missing_stage=False,
        )
        for i in range(700)
    ]
    return orders(spark, rows).cache()


@pytest.fixture(scope="module")
def found(spark, some, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    directory.write(some, path, "order_total_net_amount", "desc", ranges=9)
    return directory.open_directory(spark, path, "order_total_net_amount", "desc")


@pytest.mark.parametrize("offset", [0, 37, 240, 500, 690, 5000])
@pytest.mark.parametrize("filters", [{}, {"stage": "paid"}, {"issue_type": "unpaid", "min_severity": 2}, {"stage": "none such"}])
def test_pages_equal_the_scan(some, found, filters, offset):
    want = serving.list_orders(some, **filters, sort_by="order_total_net_amount", limit=25, offset=offset)
    got = directory.list_orders(found, **filters, limit=25, offset=offset)
    assert got.columns == want.columns and got.collect() == want.collect()


def test_a_deep_page_reads_its_ranges_only(found):
    plan = directory.list_orders(found, limit=20, offset=400)._jdf.queryExecution().executedPlan().toString()
    opened = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
    assert len(re.findall(r"\d+", re.sub(r"#\d+", "", opened))) <= 2
    assert found.rows.select(directory.RANGE).distinct().count() >= 7


def test_a_common_sort_value_is_cut(found):
    most = found.counts.groupBy(directory.RANGE).agg({"n": "sum"}).collect()
    assert max(r[1] for r in most) < 700 / 4


def test_issue_pages_equal_the_scan(some, tmp_path):
    made = batch.build_directories(some, str(tmp_path), ranges=5)
    for kind, offset in ((None, 100), ("unpaid", 30), ("strange", 0)):
        want = issues.list_issues(some, kind, limit=40, offset=offset).collect()
        assert directory.list_issues(made["issues"], kind, limit=40, offset=offset).collect() == want
    first = directory.list_orders(made["orders"], limit=10).collect()
    assert first == serving.list_orders(some, limit=10).collect()


def test_limits_are_checked(found):
    with pytest.raises(ValueError):
        directory.list_orders(found, limit=501)


def test_no_orders(spark, some, tmp_path):
    made = batch.build_directories(some.limit(0), str(tmp_path), ranges=3)
    assert directory.list_orders(made["orders"]).collect() == []
