"""What a data set writes: the frames a query needs, and no others."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from frames import chain
from ledgerline.operators import cleaning, linking
from ledgerline.plans import queries
from ledgerline.plans.store import DataSet
from ledgerline.session import settings
from ledgerline.sources import sinks

DAY = dt.datetime(1998, 1, 1)
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


@pytest.fixture
def small(spark, tmp_path):
    """Three orders; the second isn't shipped, the third is shipped and not billed."""
    orders = [(1, 1, "F", 30.0, DAY, "5-LOW"), (2, 1, "P", 9.0, DAY, "5-LOW"), (3, 2, "O", 9.0, DAY, "1-URGENT")]
    lines = [
        (1, 5, 2, 1, 1.0, 10.0, 0.0, 0.0, "R", "F", DAY),
        (1, 6, 3, 2, 2.0, 20.0, 0.0, 0.0, "A", "F", DAY),
        (2, 5, 2, 1, 1.0, 9.0, 0.1, 0.0, "N", "O", DAY),
        (3, 5, 2, 1, 1.0, 9.0, 0.0, 0.0, "N", "O", DAY),
    ]
    tables = {
        "orders": (orders, ORDERS),
        "lineitem": (lines, LINES),
        "customer": ([(1, "One", 1.0), (2, "Two", -1.0)], "c_custkey bigint, c_name string, c_acctbal double"),
        "part": ([(5, "five"), (6, "six")], "p_partkey bigint, p_name string"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/in/{name}.parquet")
    return DataSet(spark, f"{tmp_path}/in", f"{tmp_path}/out")


def written(data):
    """Folders of tables under the data set's folder."""
    return sorted(
        os.path.relpath(folder, data.folder) for folder, _, files in os.walk(data.folder) if "_SUCCESS" in files
    )


@pytest.mark.parametrize(
    "name,count,needs",
    [
        ("clean_order_headers", 3, []),
        ("clean_order_items", 4, []),
        ("items_with_headers", 4, []),
        ("billing_per_delivery", 2, []),
        ("billing_per_delivery_ordered", 2, []),
        ("clean_delivery_items", 3, ["_shipped"]),
        ("payments_per_document", 2, ["_deliveries", "_documents", "_shipped"]),
    ],
)
def test_exports_are_projections(small, name, count, needs):
    """An export that needs no join or aggregate is neither shuffled nor written."""
    assert queries.QUERIES[name](small).count() == count
    assert written(small) == [f"exports/{n}" for n in needs]


def test_export_plans_have_no_exchange(small):
    for name in ("order_headers", "order_items", "billing_items", "partners", "product_texts"):
        plan = small.exports()[name]._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    assert sorted(small.exports()) == sorted(dict(small.exports().items()))


def test_shared_frames_hold_what_is_used(small):
    shipped = queries.clean_delivery_items(small).sparkSession.read.parquet(f"{small.folder}/exports/_shipped")
    assert not {"l_tax", "l_discount", "half", "batch"} & set(shipped.columns)


def test_drops_are_compressed(small):
    for root in (small.changed(), small.jsonl()):
        parts = [f for _, _, files in os.walk(root) for f in files if f.startswith("part-")]
        assert parts and all(f.endswith(".txt.gz") for f in parts)


def test_item_queries_write_the_items_alone(small):
    found = {tuple(r) for r in queries.cancelled_billing(small).collect()}
    assert found == {
        ("1", "1.5.2.1998-01-01", True), ("1", "2.6.3.1998-01-01", False),
        ("2", "1.5.2.1998-01-01", False), ("3", "1.5.2.1998-01-01", False),
    }
    assert [t for t in written(small) if t.startswith("serving")] == ["serving/items"]


def test_order_queries_write_items_and_orders(small):
    assert queries.kpi_filtered_scan(small).first()["total_orders"] == 0  # the settled order was cancelled in part
    assert [t for t in written(small) if t.startswith("serving")] == ["serving/items", "serving/orders"]
    assert queries.customer_lookup(small).count() == 0 and queries.customer_kpis(small).count() == 2
    assert [t for t in written(small) if t.startswith("serving")] == [
        "serving/customers", "serving/items", "serving/orders",
    ]


@pytest.mark.parametrize("name", ["items_with_deliveries", "items_with_billing", "items_with_payments"])
def test_items_meet_their_documents_in_one_join(small, name):
    """Billing and payments are attached to deliveries; the item rows are not shuffled for each of them."""
    found = queries.QUERIES[name](small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    outermost = re.search(r"(?:SortMerge|ShuffledHash|BroadcastHash)Join \[(.*?)\]", plan)[1]
    assert "sales_order_item_norm" in outermost
    assert found.count() == 4


def test_attached_links_give_the_rows_of_the_item_first_chain(spark):
    """Repeated items, links and headers, and links without a delivery, multiply alike either way."""
    items = spark.createDataFrame(
        [("1", "10", 1), ("1", "10", 2), ("1", "20", 3), ("2", "10", 4), (None, "10", 5)],
        "sales_order_id string, sales_order_item string, n int",
    )
    ddl = "delivery_id string, delivery_item string, sales_order_id string, sales_order_item string"
    rows = [("D1", "a", "1", "010"), ("D1", "b", "1", "010"), (None, "c", "1", "20"), ("D2", "d", None, "10")]
    more = {"actual_delivery_qty": 1.0, "delivery_plant": "P", "storage_location": "S"}
    links = spark.createDataFrame([(*r, *more.values()) for r in rows], f"{ddl}, actual_delivery_qty double, delivery_plant string, storage_location string")
    heads = spark.createDataFrame([("D1", "x"), ("D1", "y"), (None, "z")], "delivery_id string, delivery_block string")
    billing = spark.createDataFrame([("D1", "B1"), (None, "B2")], "delivery_id string, billing_doc_id string")

    def attach(found):
        return linking.with_billing(linking.with_delivery_headers(found, heads), billing)

    got, expected = linking.with_deliveries(items, links, attach), attach(linking.with_deliveries(items, links))
    names = sorted(expected.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(names).collect())) == sorted(map(key, expected.select(names).collect()))


def test_items_are_laid_out_by_order(spark, tmp_path):
    """Items are shuffled once, by order: no order lies in two files, and the session is as it was."""
    orders = [(n, n % 3, "F", 30.0, DAY, "5-LOW") for n in range(20)]
    lines = [(n, 5, n, i, 1.0, 10.0, 0.0, 0.0, "A", "F" if i % 2 else "O", DAY) for n in range(20) for i in range(8)]
    tables = {
        "orders": (orders, ORDERS),
        "lineitem": (lines, LINES),
        "customer": ([(1, "One", 1.0)], "c_custkey bigint, c_name string, c_acctbal double"),
        "part": ([(5, "five")], "p_partkey bigint, p_name string"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/in/{name}.parquet")
    data = DataSet(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    apart = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    outside = dict(spark.conf.getAll)
    with settings(spark, apart):
        inside = dict(spark.conf.getAll)
        items = data.serving().items
        assert dict(spark.conf.getAll) == inside
    assert dict(spark.conf.getAll) == outside
    assert items.count() == 160 and items.filter("delivery_id IS NOT NULL").count() == 160
    places = items.select("sales_order_id", F.input_file_name().alias("file")).distinct().collect()
    assert len(places) == 20 and len({r["file"] for r in places}) > 1


def test_a_deep_page_writes_its_own_directory(small):
    assert queries.issues_page_deep(small).count() == 0
    assert {t.split("/")[1] for t in written(small) if t.startswith("directories")} == {"issues"}
    assert queries.orders_page_deep(small).count() == 0
    assert {t.split("/")[1] for t in written(small) if t.startswith("directories")} == {"issues", "orders"}


def test_a_drop_has_the_folders_asked_for(small):
    assert queries.scan_jsonl(small).count() == 4
    assert written(small) == ["jsonl/sales_order_items"]
    assert queries.scan_missing_folder(small).count() == 4
    assert "jsonl/outbound_delivery_items" in written(small)
    assert "jsonl/payments_accounts_receivable" not in written(small)
    assert {r.table_name: r.row_count for r in queries.load_profile(small).collect()}["payments"] == 4
    assert "jsonl/payments_accounts_receivable" in written(small)


def test_profiles_keep_one_loaded_copy(small):
    first = queries.load_profile(small).collect()
    once = written(small)
    assert queries.load_profile(small).collect() == first
    assert written(small) == once


def test_tables_by_order_meet_without_a_shuffle(small, spark):
    """Items, once laid out by order, are neither shuffled for their order's row nor for its figures."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for name, keys in (("order_context", 4), ("context_payload", 4), ("order_view", 3)):
            found = queries.QUERIES[name](small)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.count() == keys and "Bucketed: true" in plan
            for exchanged in re.findall(r"Exchange hashpartitioning\(.*\n.*", plan):
                assert "sales_order_item" not in exchanged


@pytest.mark.parametrize("name", ["unified_items", "scan_missing_folder"])
def test_the_chain_leaves_its_result_alone(small, spark, name):
    """Steps go when the items are written, as do shuffle files; the catalogue has no table more."""
    before = spark.catalog.listTables()
    plan = queries.QUERIES[name](small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [t.split("/")[2:] for t in written(small) if t.startswith("steps")] == [["items"]]
    assert queries.QUERIES[name](small).count() == 4 and spark.catalog.listTables() == before


def test_steps_give_the_rows_of_the_lazy_chain(spark, tmp_path):
    """Repeated and missing orders, deliveries and headers multiply alike with steps and without."""
    t = cleaning.clean_all(chain(spark))
    t |= {name: t[name].unionByName(t[name].limit(2)) for name in ("order_items", "delivery_items", "delivery_headers", "order_headers")}
    lazy, steps = linking.unified_items(t), sinks.Steps(spark, f"{tmp_path}/steps")
    got = sinks.stored_by(linking.unified_items(t, steps), f"{tmp_path}/items", *linking.ITEM_KEY)
    assert got.columns == lazy.columns and got.count() == lazy.count()
    assert got.exceptAll(lazy).count() == lazy.exceptAll(got).count() == 0


def test_a_table_by_a_column_replaces_the_one_before(spark, tmp_path):
    for folder in (f"{tmp_path}/t", os.path.relpath(f"{tmp_path}/it's")):
        for rows in ([("a", 1), (None, 2)], [("b", 3)]):
            found = sinks.stored_by(spark.createDataFrame(rows, "k string, n int"), folder, "k", "n")
            assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
            assert spark.read.parquet(folder).count() == len(rows)
