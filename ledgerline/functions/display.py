"""Display text for amounts, rates, durations and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"
RUPEE = "₹"

# A comma belongs before the last three digits and before every pair above them.
_LAKH_GAP = r"(?<=\d)(?=(\d\d)*\d{3}$)"


def _or_missing(text: Column) -> Column:
    return F.coalesce(text, F.lit(MISSING))


def rupees(c: Column) -> Column:
    """Whole rupees with thousands separators: ₹1,234,567."""
    return _or_missing(F.concat(F.lit(RUPEE), F.format_number(c, 0)))


def percent(c: Column, decimals: int = 1) -> Column:
    return _or_missing(F.when(c.isNotNull(), F.format_string(f"%.{decimals}f%%", c)))


def _lakh_grouped(whole: Column) -> Column:
    return F.regexp_replace(whole, _LAKH_GAP, ",")


def rupees_lakh(c: Column) -> Column:
    """Whole rupees with lakh and crore grouping: ₹12,34,567."""
    whole = F.round(F.abs(c), 0).cast("decimal(38,0)").cast("string")
    sign = F.when(c < 0, "-").otherwise("")
    return _or_missing(F.concat(F.lit(RUPEE), sign, _lakh_grouped(whole)))


def number_lakh(c: Column, decimals: int = 0) -> Column:
    """A number with lakh grouping, at least ``decimals`` and at most three decimals."""
    most = max(decimals, 3)
    digits = F.round(F.abs(c), most).cast(f"decimal(38,{most})").cast("string")
    whole = F.substring_index(digits, ".", 1)
    tail = F.substring_index(digits, ".", -1)
    trimmed = F.regexp_replace(tail, f"(?<=^\\d{{{decimals},{most}}})0+$", "")
    sign = F.when(c < 0, "-").otherwise("")
    point = F.when(trimmed == "", "").otherwise(".")
    return _or_missing(F.concat(sign, _lakh_grouped(whole), point, trimmed))


def day_count(c: Column) -> Column:
    """Days to the nearest whole day, halves upwards: 4d."""
    return _or_missing(F.concat(F.floor(c + 0.5).cast("string"), F.lit("d")))


def short_date(c: Column) -> Column:
    """02 Apr 2025."""
    return _or_missing(F.date_format(c.cast("date"), "dd MMM yyyy"))


def stage_name(c: Column) -> Column:
    return F.initcap(c)
