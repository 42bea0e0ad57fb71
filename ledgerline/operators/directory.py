"""Deep pages: a sorted table in ranges with their counts, so that an offset opens the ranges it falls into."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.bands import ISSUE_FLAGS, any_issue, issue_labels
from ledgerline.operators import serving
from ledgerline.sources import sinks

RANGE = "_range"

#: Columns of the order table that pages may be filtered by; each takes a handful of values.
FILTERS = ["lifecycle_stage", "max_issue_severity", *ISSUE_FLAGS.values()]


@dataclass(frozen=True)
class Directory:
    """``rows`` sorted by ``sort_by`` in numbered ranges, and ``counts``: rows per range and values of FILTERS."""

    rows: DataFrame
    counts: DataFrame
    sort_by: str
    sort_dir: str


def write(orders: DataFrame, path: str, sort_by: str, sort_dir: str = "desc", ranges: int = 200) -> None:
    """Write the directory of one sort order.

    Range bounds come from a sample of the sort key and the order id, so a sort
    value that a third of all orders share is cut as well.  A range is one task
    and one file; choose their number so that one holds some hundred megabytes.
    """
    keys = serving.sort_keys(orders, sort_by, sort_dir)
    placed = orders.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = placed.withColumn(RANGE, F.spark_partition_id())
    sinks.write_parts(placed, f"{path}/rows", RANGE)
    rows = sinks.open_parts(orders.sparkSession, f"{path}/rows")
    counts = rows.groupBy(RANGE, *FILTERS).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def open_directory(spark: SparkSession, path: str, sort_by: str, sort_dir: str = "desc") -> Directory:
    """What ``write`` wrote under the same sort order."""
    return Directory(sinks.open_parts(spark, f"{path}/rows"), spark.read.parquet(f"{path}/counts"), sort_by, sort_dir)


def page(found: Directory, choose: Callable[[DataFrame], DataFrame], limit: int, offset: int) -> DataFrame:
    """The chosen rows from ``offset`` on, ``limit`` at most, each with the number of all chosen rows.

    ``choose`` filters by columns of FILTERS, first the counts, then the rows.
    Counts per range, a number for each, come to the driver; only ranges the
    page falls into are read and sorted.
    """
    serving.check_page(limit, offset)
    per_range = choose(found.counts).groupBy(RANGE).agg(F.sum("n").alias("n")).collect()
    opened, before, seen = [], 0, 0
    for number, n in sorted(map(tuple, per_range)):
        if seen + n <= offset:
            before = seen + n
        elif seen < offset + limit:
            opened.append(number)
        seen += n
    rows = choose(found.rows.filter(F.col(RANGE).isin(opened))).drop(RANGE)
    keys = serving.sort_keys(rows, found.sort_by, found.sort_dir)
    return rows.orderBy(*keys).offset(offset - before).limit(limit).withColumn("total", F.lit(seen).cast("long"))


def list_orders(
    found: Directory,
    stage: str | None = None,
    issue_type: str | None = None,
    min_severity: int | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """``serving.list_orders`` in the directory's order, at a cost that doesn't grow with the offset."""

    def choose(table: DataFrame) -> DataFrame:
        return serving.select_orders(table, stage=stage, min_severity=min_severity, issue_type=issue_type)

    return page(found, choose, limit, offset)


def list_issues(
    found: Directory,
    issue_type: str | None = None,
    min_severity: int | None = None,
    stage: str | None = None,
    limit: int = 200,
    offset: int = 0,
) -> DataFrame:
    """``issues.list_issues`` out of a directory sorted by severity."""

    def choose(table: DataFrame) -> DataFrame:
        chosen = serving.select_orders(table, stage=stage, min_severity=min_severity)
        return chosen.filter(serving.with_flag(issue_type) if issue_type in ISSUE_FLAGS else any_issue())

    return page(found, choose, limit, offset).withColumn("issue_labels", issue_labels())
