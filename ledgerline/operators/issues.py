"""Flagged orders: lists with labels, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.bands import ISSUE_FLAGS, any_issue, issue_labels
from ledgerline.operators import serving


def list_issues(
    orders: DataFrame,
    issue_type: str | None = None,
    min_severity: int | None = None,
    customer: object = None,
    stage: str | None = None,
    limit: int = 200,
    offset: int = 0,
) -> DataFrame:
    """Flagged orders by severity, each with its issue labels.

    An unknown or absent type selects orders with any of the four issues.
    """
    chosen = serving.select_orders(orders, customer, stage, min_severity)
    wanted = serving.with_flag(issue_type) if issue_type in ISSUE_FLAGS else any_issue()
    keys = [F.desc_nulls_last("max_issue_severity"), F.asc("sales_order_id")]
    return serving.page(chosen.filter(wanted), keys, limit, offset).withColumn(
        "issue_labels", issue_labels()
    )


def counts_by_type(orders: DataFrame) -> DataFrame:
    """Orders per issue type, one row per type."""
    counts = orders.agg(*[F.count_if(flag).alias(name) for name, flag in ISSUE_FLAGS.items()])
    return counts.unpivot([], list(ISSUE_FLAGS), "issue_type", "order_count")


def total_flagged(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count_if(any_issue()).alias("total_flagged"))


def severity_histogram(orders: DataFrame) -> DataFrame:
    """Orders per severity, lowest first."""
    score = F.coalesce(F.col("max_issue_severity"), F.lit(0)).cast("bigint")
    return (
        orders.groupBy(score.alias("severity"))
        .agg(F.count(F.lit(1)).alias("order_count"))
        .orderBy("severity")
    )
