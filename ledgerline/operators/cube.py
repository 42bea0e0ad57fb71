"""KPIs by customer and stage, added up once and merged at request time.

Every figure of a filtered KPI request is a sum, a count, or a median of day
counts.  Sums and counts are kept per cell (customer and stage, and each alone);
day counts, which take few distinct values, as how often each occurs, so that
medians stay exact.  A request reads the cells of its own level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import kpis
from ledgerline.operators.milestones import CYCLES
from ledgerline.sources import sinks

#: Flags counted where true, and where known at all.
_FLAGS = ["is_delivery_delayed", "is_billing_cancelled", "is_unpaid", "missing_stage"]
_RATED = ["is_billing_cancelled", "is_delivery_delayed"]

_KEYS = ["customer_id", "lifecycle_stage"]


@dataclass(frozen=True)
class Cube:
    """``cells``: additive figures per level and cell; ``days``: how often each day count occurs in a cell."""

    cells: DataFrame
    days: DataFrame


def _level() -> Column:
    """Which filters a grouping answers."""
    customer, stage = (F.grouping(c) == 0 for c in _KEYS)
    return (
        F.when(customer & stage, "both").when(customer, "customer").when(stage, "stage").otherwise("all").alias("level")
    )


def _sets(*more: str) -> list[list[Column]]:
    return [[F.col(c) for c in (*keys, *more)] for keys in ([], ["lifecycle_stage"], ["customer_id"], _KEYS)]


def _base(orders: DataFrame) -> DataFrame:
    """One row per customer, stage and pair of day counts that have medians: all orders, combined before any grouping set."""
    to_delivery, *_, whole = CYCLES
    return orders.groupBy(*_KEYS, to_delivery, whole).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("total_items").alias("total_order_items"),
        F.sum("order_total_net_amount").alias("revenue"),
        F.sum("total_paid_amount").alias("paid"),
        *[F.sum(c).alias(f"sum_{c}") for c in CYCLES],
        *[F.count(c).alias(f"n_{c}") for c in CYCLES],
        *[F.count_if(f).alias(f) for f in _FLAGS],
        *[F.count(f).alias(f"known_{f}") for f in _RATED],
    )


def build(orders: DataFrame) -> Cube:
    """The cube of an order table.

    Orders are combined to cells first, before the shuffle, so the grouping sets
    multiply cells and not orders, and a customer with a third of all orders is
    few rows.  Customers of a stage are counted as cells, which have one row per
    customer.
    """
    base = _base(orders)
    to_delivery, *_, whole = CYCLES
    sums = [c for c in base.columns if c not in (*_KEYS, to_delivery, whole)]
    cells = base.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in sums])
    cells = cells.withColumn("customer", F.col("customer_id"))
    figures = [F.sum(c).alias(c) for c in sums]
    customers = F.count_distinct("customer").alias("unique_customers")
    by_level = cells.groupingSets(_sets(), *[F.col(c) for c in _KEYS]).agg(_level(), *figures, customers)

    measured = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("day")) for c in (to_delivery, whole)]))
    days = base.select(*_KEYS, "total_orders", measured.alias("d")).filter("d.day IS NOT NULL")
    days = days.groupBy(*_KEYS, "d.measure", "d.day").agg(F.sum("total_orders").alias("n"))
    keys = [F.col(c) for c in (*_KEYS, "measure", "day")]
    days = days.groupingSets(_sets("measure", "day"), *keys).agg(_level(), F.sum("n").alias("n"))
    return Cube(
        by_level.select("level", *_KEYS, *sums, "unique_customers"), days.select("level", *_KEYS, "measure", "day", "n")
    )


def write(cube: Cube, path: str) -> None:
    """Both tables by level; within one sorted by customer and stage, in ranges, so that a request opens few row groups."""
    for name, table in (("cells", cube.cells), ("days", cube.days)):
        placed = table.repartitionByRange("level", *_KEYS).sortWithinPartitions("level", *_KEYS)
        sinks.write_parts(placed, f"{path}/{name}", "level")


def open_cube(spark: SparkSession, path: str) -> Cube:
    """What ``write`` wrote."""
    return Cube(sinks.open_parts(spark, f"{path}/cells"), sinks.open_parts(spark, f"{path}/days"))


def _chosen(table: DataFrame, customer: str | None, stage: str | None) -> DataFrame:
    level = "both" if customer and stage else "customer" if customer else "stage" if stage else "all"
    found = table.filter(F.col("level") == level)
    if customer:
        found = found.filter(F.col("customer_id") == str(customer))
    return found.filter(F.col("lifecycle_stage") == stage) if stage else found


def filtered_kpis(cube: Cube, customer: str | None = None, stage: str | None = None) -> DataFrame:
    """``kpis.filtered_kpis`` of the same filters, from the cube: one flat row.

    No orders give counts of 0 and NULL figures, as there.
    """
    found = _chosen(cube.cells, customer, stage)

    def mean(c: str) -> Column:
        return F.round(F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0)), 2)

    def rate(flag: str) -> Column:
        return F.round(F.sum(flag) / F.nullif(F.sum(f"known_{flag}"), F.lit(0)) * 100, 1)

    def count(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    to_delivery, to_billing, to_payment, whole = CYCLES
    middles = _chosen(cube.days, customer, stage).agg(
        *[
            F.expr(f"percentile(CASE WHEN measure = '{c}' THEN day END, 0.5D, n)").alias(c)
            for c in (to_delivery, whole)
        ]
    )
    middle = middles.select(F.struct(to_delivery, whole)).scalar()
    money = [F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2) for c in ("revenue", "paid")]
    cycles = [mean(to_delivery), F.lit(None), mean(to_billing), mean(to_payment), mean(whole), F.lit(None)]
    flags = [*[count(f) for f in _FLAGS], rate("is_billing_cancelled"), rate("is_delivery_delayed")]
    figures = found.agg(
        *[count(c).alias(c) for c in ("total_orders", "total_order_items", "unique_customers")],
        money[0].alias("total_revenue_inr"),
        money[1].alias("total_paid_inr"),
        *[c.alias(name) for c, name in zip(cycles, kpis.CYCLE_STATS) if not name.startswith("median")],
        *[c.alias(name) for c, name in zip(flags, kpis.FILTERED_ISSUES)],
    )
    revenue, paid = F.col("total_revenue_inr"), F.col("total_paid_inr")
    return (
        figures.withColumn("_middle", middle)
        .withColumn("median_order_to_delivery_days", F.round(F.col(f"_middle.{to_delivery}"), 2))
        .withColumn("median_total_o2c_days", F.round(F.col(f"_middle.{whole}"), 2))
        .withColumn("revenue_leakage_inr", F.round(revenue - paid, 2))
        .withColumn("payment_coverage_pct", F.when(revenue != 0, F.round(paid / revenue * 100, 1)).otherwise(F.lit(0.0)))
        .select(*kpis.FILTERED_OVERVIEW, *kpis.CYCLE_STATS, *kpis.FILTERED_ISSUES)
    )


def stage_map(cube: Cube, customer: str | None = None, stage: str | None = None) -> DataFrame:
    """Orders per stage of the chosen ones as one map, most frequent first."""
    level = "both" if customer else "stage"
    cells = cube.cells.filter((F.col("level") == level) & F.col("lifecycle_stage").isNotNull())
    if customer:
        cells = cells.filter(F.col("customer_id") == str(customer))
    if stage:
        cells = cells.filter(F.col("lifecycle_stage") == stage)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("total_orders")).alias("rank"), "lifecycle_stage")))
    entries = F.transform(ranked, lambda e: F.struct(e["lifecycle_stage"], -e["rank"]))
    return cells.agg(F.map_from_entries(entries).alias("lifecycle_stages"))


def summary(document: DataFrame, cube: Cube, customer: str | None = None, stage: str | None = None) -> DataFrame:
    """The stored KPI document when nothing is filtered, else the document of the chosen orders out of the cube."""
    if not customer and not stage:
        return document
    return kpis.nested(filtered_kpis(cube, customer, stage), stage_map(cube, customer, stage), customer, stage)
