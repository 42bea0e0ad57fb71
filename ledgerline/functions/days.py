"""Durations in whole days and the overdue test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _floor_days(span: Column) -> Column:
    # The day field truncates towards zero, so a negative span is turned round
    # and lengthened by just under a day first.
    just_under = F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")
    ahead = F.date_part(F.lit("DAY"), span)
    back = -F.date_part(F.lit("DAY"), just_under - span)
    zero = F.expr("INTERVAL '0' SECOND")
    return F.when(span >= zero, ahead).otherwise(back).cast("bigint")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days from start to end, rounded down (−1 hour is −1 day)."""
    return _floor_days(end - start)


def rounded_days(start: Column, end: Column) -> Column:
    """Days from start to end to the nearest whole day, halves upwards."""
    return _floor_days((end + F.expr("INTERVAL 12 HOURS")) - start)


def overdue_as_of(billed: Column, term_days: Column, as_of: Column) -> Column:
    """Whether the due moment (billing plus term, time of day kept) has passed."""
    due = billed + F.make_dt_interval(term_days.cast("int"))
    return F.coalesce(due < as_of, F.lit(False))
