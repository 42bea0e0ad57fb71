"""Items rolled up to orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.milestones import CYCLES

# Stage names in alphabetical order: the order in which ties are settled.
_STAGE_NAMES = ["billed", "cancelled", "delivered", "ordered", "paid"]

# Columns of the order table that an order's items share, because they come from its header.
_HEADER = [
    "customer_id",
    "customer_name",
    "order_created_date",
    "requested_delivery_date",
    "payment_terms",
    "currency",
    "order_total_net_amount",
]
# Issue flags of the order table.
_FLAGS = [
    "is_delivery_delayed",
    "is_payment_overdue",
    "is_billing_cancelled",
    "is_unpaid",
    "missing_stage",
]


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per key, the smallest on a tie; NULLs do not count.

    Counted per (key, value) first, so a hot key spreads over its values.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def _most_frequent_stage() -> Column:
    counts = [F.col(f"_n_{name}") for name in _STAGE_NAMES]
    top = F.greatest(*counts)
    choice = F.lit(None).cast("string")
    for name, n in reversed(list(zip(_STAGE_NAMES, counts))):
        choice = F.when((n == top) & (top > 0), name).otherwise(choice)
    return choice


def _numbers() -> list[Column]:
    """What an order's items add up to; numbers only, so that the aggregate hashes."""
    return [
        F.count("sales_order_item").alias("total_items"),
        F.sum("billed_amount_sum").alias("total_billed_amount"),
        F.sum("total_amount_paid").alias("total_paid_amount"),
        *[F.count_if(F.col("lifecycle_stage") == s).alias(f"_n_{s}") for s in _STAGE_NAMES],
        *[F.min(c).alias(c) for c in CYCLES],
        *[F.bool_or(c).alias(c) for c in _FLAGS],
        F.max("issue_severity").alias("max_issue_severity"),
    ]


def order_view(items: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row per order.

    With ``headers`` (one row per order, customer name included) items are
    grouped by order id alone: one shuffle of combined numbers, and the header
    columns join them.  Without, header columns are taken from the items: they
    are grouping keys of a first step, so that its buffers hold numbers only (a
    text minimum would force a sort of all items), and a second step over one
    row per order settles those that differ on the smallest value.
    """
    known = items.filter(F.col("sales_order_id").isNotNull())
    if headers is not None:
        numbers = known.groupBy("sales_order_id").agg(*_numbers())
        orders = numbers.join(headers.select("sales_order_id", *_HEADER), "sales_order_id", "left")
    else:
        per_header = known.groupBy("sales_order_id", *_HEADER).agg(*_numbers())
        orders = per_header.groupBy("sales_order_id").agg(
            *[F.min(c).alias(c) for c in _HEADER],
            F.sum("total_items").alias("total_items"),
            F.sum("total_billed_amount").alias("total_billed_amount"),
            F.sum("total_paid_amount").alias("total_paid_amount"),
            *[F.sum(f"_n_{s}").alias(f"_n_{s}") for s in _STAGE_NAMES],
            *[F.min(c).alias(c) for c in CYCLES],
            *[F.bool_or(c).alias(c) for c in _FLAGS],
            F.max("max_issue_severity").alias("max_issue_severity"),
        )
    return orders.select(
        "sales_order_id",
        *_HEADER,
        "total_items",
        F.coalesce("total_billed_amount", F.lit(0.0)).alias("total_billed_amount"),
        F.coalesce("total_paid_amount", F.lit(0.0)).alias("total_paid_amount"),
        _most_frequent_stage().alias("lifecycle_stage"),
        *CYCLES,
        *_FLAGS,
        "max_issue_severity",
        leakage().alias("revenue_leakage_amount"),
    )


def leakage() -> Column:
    """Order value less what was paid for its items."""
    return F.col("order_total_net_amount") - F.coalesce(F.col("total_paid_amount"), F.lit(0.0))
