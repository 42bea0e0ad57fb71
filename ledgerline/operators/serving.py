"""Filtered, sorted and paged reads of the order and item tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.bands import ISSUE_FLAGS

# Fixed value: rows on a page at most.
MAX_PAGE = 500

DEFAULT_SORT = "order_created_date"


def of_customer(customer: object) -> Column:
    return F.col("customer_id").cast("string") == F.lit(str(customer))


def in_stage(stage: str) -> Column:
    return F.col("lifecycle_stage") == stage


def at_least(severity: int) -> Column:
    return F.coalesce(F.col("max_issue_severity"), F.lit(0)) >= severity


def with_flag(issue_type: str) -> Column:
    return F.coalesce(F.col(ISSUE_FLAGS[issue_type]), F.lit(False))


def needs_attention() -> Column:
    """Some severity, or cancelled billing."""
    return (F.col("max_issue_severity") > 0) | F.col("is_billing_cancelled")


def select_orders(
    orders: DataFrame,
    customer: object = None,
    stage: str | None = None,
    min_severity: int | None = None,
    issue_type: str | None = None,
) -> DataFrame:
    """Orders that meet every filter given; an unknown issue type filters nothing."""
    tests = [
        of_customer(customer) if customer else None,
        in_stage(stage) if stage else None,
        at_least(min_severity) if min_severity else None,
        with_flag(issue_type) if issue_type in ISSUE_FLAGS else None,
    ]
    given = [t for t in tests if t is not None]
    return orders.filter(reduce(and_, given)) if given else orders


def sort_orders(orders: DataFrame, sort_by: str = DEFAULT_SORT, sort_dir: str = "desc") -> DataFrame:
    """Sorted by any column with NULLs last, ties by order id.

    An unknown column leaves the table order, which is by order id.
    """
    return orders.orderBy(*sort_keys(orders, sort_by, sort_dir))


def sort_keys(orders: DataFrame, sort_by: str, sort_dir: str) -> list[Column]:
    """NULLs last either way, ties by order id; by id alone for an unknown column."""
    tiebreak = F.asc("sales_order_id")
    if sort_by not in orders.columns:
        return [tiebreak]
    key = F.asc_nulls_last(sort_by) if sort_dir == "asc" else F.desc_nulls_last(sort_by)
    return [key, tiebreak]


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must lie in 1..{MAX_PAGE} and offset be at least 0, not {limit}, {offset}")


def page(chosen: DataFrame, keys: list[Column], limit: int, offset: int) -> DataFrame:
    """One page of the sorted rows, each with the number of rows on all pages.

    The total is a scalar subquery, not a window over the whole table.  Limits
    from 1 to ``MAX_PAGE`` and offsets from 0 are allowed, others are an error.
    """
    check_page(limit, offset)
    total = chosen.agg(F.count(F.lit(1))).scalar()
    return chosen.orderBy(*keys).offset(offset).limit(limit).withColumn("total", total)


def list_orders(
    orders: DataFrame,
    customer: object = None,
    stage: str | None = None,
    issue_type: str | None = None,
    min_severity: int | None = None,
    sort_by: str = DEFAULT_SORT,
    sort_dir: str = "desc",
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Filter, sort and page the order table."""
    chosen = select_orders(orders, customer, stage, min_severity, issue_type)
    return page(chosen, sort_keys(orders, sort_by, sort_dir), limit, offset)


def order_by_id(orders: DataFrame, order_id: object) -> DataFrame:
    """The order, or no row."""
    return orders.filter(F.col("sales_order_id") == str(order_id)).limit(1)


def order_items(items: DataFrame, order_id: object) -> DataFrame:
    """Every item row of one order, each with their number."""
    mine = items.filter(F.col("sales_order_id") == str(order_id))
    return mine.withColumn("item_count", mine.agg(F.count(F.lit(1))).scalar())


def customer_by_id(customers: DataFrame, customer_id: object) -> DataFrame:
    return customers.filter(of_customer(customer_id)).limit(1)


def customer_orders(orders: DataFrame, customer_id: object) -> DataFrame:
    """Every order of one customer, each with their number."""
    mine = orders.filter(of_customer(customer_id))
    return mine.withColumn("order_count", mine.agg(F.count(F.lit(1))).scalar())


def filter_values(orders: DataFrame) -> DataFrame:
    """Distinct stages and customers for the pick lists."""
    lists = [
        orders.select(F.lit(name).alias("list_name"), F.col(column).alias("list_value")).distinct()
        for name, column in (("stage", "lifecycle_stage"), ("customer", "customer_id"))
    ]
    return lists[0].unionByName(lists[1]).orderBy("list_name", "list_value")


def order_context(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Every item row of every order next to the order's row: columns order and item.

    One row per item at any size; the nested form is for one order at a time
    (``order_document``).  An order without items keeps a row with a NULL item.
    """
    headers = orders.select("sales_order_id", F.struct(*orders.columns).alias("order"))
    rows = items.select("sales_order_id", F.struct(*items.columns).alias("item"))
    return headers.join(rows, "sales_order_id", "left")


def order_document(orders: DataFrame, items: DataFrame, order_id: object) -> DataFrame:
    """The row of one order with all its items, all columns, as an array."""
    mine = order_items(items, order_id).drop("item_count")
    nested = mine.agg(F.sort_array(F.collect_list(F.struct(*mine.columns)))).scalar()
    return order_by_id(orders, order_id).withColumn("items", nested)
