"""Look-ups out of the grid against look-ups in the whole order table, and what they read."""

import glob

import pytest

from frames import orders
from ledgerline.operators import grid, serving
from ledgerline.plans import batch

HOT = "c0"


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        dict(
            sales_order_id=None if i % 97 == 5 else f"o{i:04}",
            customer_id=None if i % 50 == 1 else HOT if i % 3 == 0 else f"c{i % 41}",
            max_issue_severity=i % 4, order_total_net_amount=float(i % 60),
        )
        for i in range(1200)
    ]
    return orders(spark, rows).cache()


@pytest.fixture(scope="module")
def laid_out(spark, some, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grid"))
    return path, batch.build_grid(some, path, slices=8)


def sorted_rows(df):
    return sorted(df.collect(), key=str)


def leaf(df):
    """The scan of a plan that has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)


def test_layout_keeps_every_order(some, laid_out):
    rows = laid_out[1].rows.drop(grid.CUSTOMER, grid.ORDER)
    assert rows.columns == some.columns and sorted_rows(rows) == sorted_rows(some)


@pytest.mark.parametrize("customer", [HOT, "c7", 7, "nobody", ""])
def test_customers(some, laid_out, customer):
    found = laid_out[1]
    want = serving.customer_orders(some, customer)
    got = grid.customer_orders(found, customer)
    assert got.columns == want.columns and sorted_rows(got) == sorted_rows(want)
    page = dict(min_severity=2, sort_by="order_total_net_amount", limit=15, offset=3)
    assert grid.list_orders(found, customer, **page).collect() == serving.list_orders(some, customer=customer, **page).collect()


@pytest.mark.parametrize("order", ["o0000", "o0731", "o9999", 12])
def test_orders(some, laid_out, order):
    assert grid.order_by_id(laid_out[1], order).collect() == serving.order_by_id(some, order).collect()


@pytest.mark.parametrize("key", ["customer", "order"])
def test_a_look_up_opens_one_slice(laid_out, key):
    path, found = laid_out
    every = {f.removeprefix(path) for f in glob.glob(f"{path}/rows/*/*/*.parquet")}
    assert len(every) == 64  # a file a cell
    chosen = found.of_customer(HOT) if key == "customer" else found.of_order("o0731")
    scan = leaf(chosen)
    assert scan.metrics().apply("numFiles").value() == 8
    assert scan.metrics().apply("numPartitions").value() == 8


def test_a_hot_customer_fills_many_cells(spark, laid_out):
    found = laid_out[1]
    per_cell = found.rows.groupBy(grid.CUSTOMER, grid.ORDER).count().collect()
    assert max(r["count"] for r in per_cell) < 1200 / 8


def test_row_groups_of_absent_keys_are_skipped(spark, some, tmp_path):
    """Within the range of values of its cell, an order id that isn't there is told by the Bloom filter."""
    distinct = some.filter("sales_order_id IS NOT NULL").dropDuplicates(["sales_order_id"])
    grid.write(distinct, str(tmp_path), slices=1)
    found = grid.open_grid(spark, str(tmp_path))
    assert leaf(grid.order_by_id(found, "o0500x")).metrics().apply("numOutputRows").value() == 0
    assert leaf(grid.order_by_id(found, "o0501")).metrics().apply("numOutputRows").value() > 0


def test_no_orders(some, tmp_path):
    found = batch.build_grid(some.limit(0), str(tmp_path), slices=3)
    assert found.rows.columns == [*some.columns, grid.CUSTOMER, grid.ORDER]
    assert grid.customer_orders(found, HOT).collect() == [] and grid.order_by_id(found, "o1").collect() == []


def test_written_again(spark, some, tmp_path):
    batch.build_grid(some, str(tmp_path), slices=3)
    found = batch.build_grid(some.limit(10), str(tmp_path), slices=2)
    assert (found.slices, found.rows.count()) == (2, 10)
