"""Look-ups by customer and by order from one copy of the order table, laid out in a grid of both keys' hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import serving
from ledgerline.sources import sinks

#: Folder columns: the row and the column of a cell.
CUSTOMER, ORDER = "_customer", "_order"


@dataclass(frozen=True)
class Grid:
    """``rows`` in ``slices`` times ``slices`` folders: one way by a hash of the customer, the other of the order."""

    rows: DataFrame
    slices: int

    def of_customer(self, customer_id: object) -> DataFrame:
        """The orders in the ``slices`` cells a customer's can be in."""
        return self._cells(F.col(CUSTOMER) == _slice(F.lit(str(customer_id)), self.slices))

    def of_order(self, order_id: object) -> DataFrame:
        """The orders in the ``slices`` cells an order can be in."""
        return self._cells(F.col(ORDER) == _slice(F.lit(str(order_id)), self.slices))

    def _cells(self, chosen: Column) -> DataFrame:
        return self.rows.filter(chosen).drop(CUSTOMER, ORDER)


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slices)).cast("int")


def write(orders: DataFrame, path: str, slices: int = 32) -> None:
    """Write the grid of an order table.

    A look-up by either key opens one of ``slices`` parts of the table, at most
    ``slices`` files.  A cell is one task and one file; a customer with a third
    of all orders fills a whole row of cells, so no task gets more than about
    that share divided by ``slices``.  Rows are sorted by customer and order
    within a cell, and Bloom filters on both keys let a look-up skip row groups
    whose value range doesn't tell.  Orders without a customer or an id lie in
    the cells of the NULL key.
    """
    placed = orders.withColumns(
        {CUSTOMER: _slice(F.col("customer_id"), slices), ORDER: _slice(F.col("sales_order_id"), slices)}
    )
    placed = placed.repartition(slices * slices, CUSTOMER, ORDER)
    placed = placed.sortWithinPartitions(CUSTOMER, ORDER, "customer_id", "sales_order_id")
    blooms = {f"parquet.bloom.filter.enabled#{key}": "true" for key in ("customer_id", "sales_order_id")}
    sinks.write_parts(
        placed, f"{path}/rows", CUSTOMER, ORDER, options=blooms | {"parquet.bloom.filter.adaptive.enabled": "true"}
    )
    layout = orders.sparkSession.range(1).select(F.lit(slices).alias("slices"))
    layout.write.mode("overwrite").json(f"{path}/layout")


def open_grid(spark: SparkSession, path: str) -> Grid:
    """What ``write`` wrote."""
    slices = spark.read.schema("slices int").json(f"{path}/layout").first()["slices"]
    return Grid(sinks.open_parts(spark, f"{path}/rows"), slices)


def order_by_id(grid: Grid, order_id: object) -> DataFrame:
    """``serving.order_by_id`` out of the grid."""
    return serving.order_by_id(grid.of_order(order_id), order_id)


def customer_orders(grid: Grid, customer_id: object) -> DataFrame:
    """``serving.customer_orders`` out of the grid."""
    return serving.customer_orders(grid.of_customer(customer_id), customer_id)


def list_orders(grid: Grid, customer: object = None, **choices: object) -> DataFrame:
    """``serving.list_orders`` out of the grid; without a customer (or with an empty one) it reads all cells."""
    rows = grid.of_customer(customer) if customer else grid.rows.drop(CUSTOMER, ORDER)
    return serving.list_orders(rows, customer=customer, **choices)
