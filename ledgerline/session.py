"""Session settings the operators rely on at scale."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings, none of which changes a result.  Skewed join partitions are
# split even when that costs one more shuffle: a delivery or an order may hold
# a third of all rows, and the joins sharing one partitioning would otherwise
# leave that key in a single task.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The item rows are wide; generated methods over this size are never compiled
    # by the JVM, and those just under it only after long interpretation, so
    # stages over wide rows run faster as separate operators.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.codegen.maxFields": "40",
    # A join whose build side turns out small in every partition hashes it
    # instead of sorting both sides; larger or skewed partitions still sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


# For tables that are written and then read: shuffle files go when the write
# ends, and rows laid out by some of a join's keys stay where they are.
WRITTEN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """``values`` while the block plans and runs; what the caller had afterwards."""
    before = {name: value for name, value in spark.conf.getAll.items() if name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in values:
            spark.conf.set(name, before[name]) if name in before else spark.conf.unset(name)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings to a session that already runs."""
    for name, value in ADAPTIVE.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", app: str = "ledgerline", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", "12g")
    )
    for name, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
