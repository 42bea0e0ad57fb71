"""Severity bands, risk tiers, issue labels and stage positions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Issue types, the flag each stands for, and its description.
ISSUE_FLAGS = {
    "delayed": "is_delivery_delayed",
    "cancelled": "is_billing_cancelled",
    "unpaid": "is_unpaid",
    "missing": "missing_stage",
}
ISSUE_LABELS = {
    "is_delivery_delayed": "Delivery delayed beyond threshold",
    "is_billing_cancelled": "Billing document cancelled",
    "is_unpaid": "Invoice raised but no payment received",
    "missing_stage": "Incomplete lifecycle — missing stage",
}

# Short flag captions of the order list, overdue included.
FLAG_CAPTIONS = {
    "is_delivery_delayed": "Delayed delivery",
    "is_payment_overdue": "Payment overdue",
    "is_billing_cancelled": "Billing cancelled",
    "is_unpaid": "Unpaid",
    "missing_stage": "Missing stage",
}

# The stages of an order that is not cancelled, first to last.
STAGES = ["ordered", "delivered", "billed", "paid"]


def _captions(texts: Mapping[str, str]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col(flag), F.lit(text)) for flag, text in texts.items()])
    )


def issue_labels() -> Column:
    """Descriptions of the set flags, in a fixed order."""
    return _captions(ISSUE_LABELS)


def flag_captions() -> Column:
    """Short captions of the set flags, in a fixed order."""
    return _captions(FLAG_CAPTIONS)


def any_issue() -> Column:
    """Whether one of the four issue flags is set."""
    flags = [F.coalesce(F.col(flag), F.lit(False)) for flag in ISSUE_FLAGS.values()]
    found = flags[0]
    for flag in flags[1:]:
        found = found | flag
    return found


def severity_level(score: Column) -> Column:
    return F.when(score >= 4, "critical").when(score >= 2, "warning").otherwise("info")


def severity_caption(score: Column) -> Column:
    return F.when(score >= 4, "Critical").when(score >= 2, "Warning").otherwise("Low")


def severity_band(score: Column) -> Column:
    """Five-step band, 0 (none) to 4."""
    return F.greatest(F.least(F.coalesce(score, F.lit(0)), F.lit(4)), F.lit(0)).cast("bigint")


def card_tier(risk: Column) -> Column:
    """Customer risk on the profile card: a fifth of the score, at most 5."""
    return F.least(F.floor(risk / 5), F.lit(5)).cast("bigint")


def table_tier(risk: Column) -> Column:
    """Customer risk in the ranking table: the score itself, at most 5."""
    return F.least(risk, F.lit(5)).cast("bigint")


def stage_position(stage: Column) -> Column:
    """Index of the stage, −1 for cancelled or unknown."""
    listed = F.array(*[F.lit(s) for s in STAGES])
    return F.coalesce(F.array_position(listed, stage) - 1, F.lit(-1)).cast("bigint")


def stage_track(stage: Column) -> Column:
    """Each stage with its state: done, active or open."""
    at = stage_position(stage)
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("stage"),
                F.when(at > i, "done").when(at == i, "active").otherwise("open").alias("state"),
            )
            for i, name in enumerate(STAGES)
        ]
    )
