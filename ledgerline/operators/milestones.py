"""Columns derived per item: cycle times, stage, issue flags, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.coerce import not_blank, payment_term_days
from ledgerline.functions.days import elapsed_days

# Days allowed from order to delivery; days, start and end of each cycle.
DELIVERY_DELAY_DAYS = 3
CYCLES = {
    "order_to_delivery_days": ("order_created_date", "delivery_created_date"),
    "delivery_to_billing_days": ("delivery_created_date", "billing_date"),
    "billing_to_payment_days": ("billing_date", "payment_posting_date"),
    "total_o2c_days": ("order_created_date", "payment_posting_date"),
}


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _cycles() -> dict[str, Column]:
    return {name: elapsed_days(F.col(start), F.col(end)) for name, (start, end) in CYCLES.items()}


def _stages() -> dict[str, Column]:
    delivered = F.col("delivery_id").isNotNull()
    billed = F.col("billing_doc_id").isNotNull()
    return {
        "lifecycle_stage": stage(),
        "has_delivery": delivered,
        "has_billing": billed,
        "has_payment": F.col("payment_posting_date").isNotNull(),
        "missing_stage": ~delivered | ~billed,
    }


def _delayed(allowed_days: int) -> dict[str, Column]:
    return {"is_delivery_delayed": _or_false(F.col("order_to_delivery_days") > allowed_days)}


def _overdue(terms: dict[str, int] | None) -> dict[str, Column]:
    expected = payment_term_days(F.col("payment_terms"), terms)
    return {
        "expected_payment_days": expected,
        "is_payment_overdue": _or_false(F.col("billing_to_payment_days") > expected),
    }


def _unpaid() -> dict[str, Column]:
    return {
        "is_unpaid": F.col("billing_doc_id").isNotNull()
        & F.col("payment_posting_date").isNull()
        & ~_or_false(F.col("is_cancelled"))
    }


def _cancelled() -> dict[str, Column]:
    return {"is_billing_cancelled": _or_false(F.col("is_cancelled"))}


def _rejected() -> dict[str, Column]:
    return {"is_rejected": not_blank(F.col("rejection_reason"))}


def _blocked() -> dict[str, Column]:
    return {"has_delivery_block": not_blank(F.col("delivery_block_reason"))}


def stage() -> Column:
    """The furthest document reached; cancelled billing outranks all."""
    return (
        F.when(F.col("is_cancelled"), "cancelled")
        .when(F.col("payment_posting_date").isNotNull(), "paid")
        .when(F.col("billing_doc_id").isNotNull(), "billed")
        .when(F.col("delivery_id").isNotNull(), "delivered")
        .otherwise("ordered")
    )


def cycle_times(items: DataFrame) -> DataFrame:
    """Days between the documents of the chain."""
    return items.withColumns(_cycles())


def stages(items: DataFrame) -> DataFrame:
    """Stage, presence of each document, and whether the chain has a gap."""
    return items.withColumns(_stages())


def delivery_delayed(items: DataFrame, allowed_days: int = DELIVERY_DELAY_DAYS) -> DataFrame:
    """Delivered later than allowed; needs the cycle times."""
    return items.withColumns(_delayed(allowed_days))


def payment_overdue(items: DataFrame, terms: dict[str, int] | None = None) -> DataFrame:
    """Paid later than the payment terms allow; needs the cycle times."""
    return items.withColumns(_overdue(terms))


def unpaid(items: DataFrame) -> DataFrame:
    """Billed, not paid, and not known to be cancelled."""
    return items.withColumns(_unpaid())


def billing_cancelled(items: DataFrame) -> DataFrame:
    return items.withColumns(_cancelled())


def rejected(items: DataFrame) -> DataFrame:
    return items.withColumns(_rejected())


def delivery_blocked(items: DataFrame) -> DataFrame:
    return items.withColumns(_blocked())


# The flags that make up the severity.
SCORED_FLAGS = [
    "is_delivery_delayed",
    "is_payment_overdue",
    "is_billing_cancelled",
    "is_unpaid",
    "missing_stage",
]


def severity(items: DataFrame) -> DataFrame:
    """Number of scored flags that are set, 0 to 5."""
    score = F.lit(0).cast("bigint")
    for name in SCORED_FLAGS:
        score = score + F.col(name).cast("bigint")
    return items.withColumn("issue_severity", score)


def with_milestones(
    items: DataFrame,
    delivery_delay_days: int = DELIVERY_DELAY_DAYS,
    terms: dict[str, int] | None = None,
) -> DataFrame:
    """All derived columns, in three steps that each use the one before."""
    timed = items.withColumns({**_cycles(), **_stages()})
    flagged = timed.withColumns(
        {
            **_delayed(delivery_delay_days),
            **_overdue(terms),
            **_unpaid(),
            **_cancelled(),
            **_rejected(),
            **_blocked(),
        }
    )
    return severity(flagged)
