"""Sinks: serving tables, keyed publish, append logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import WRITTEN, settings


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, replacing what is there; booleans as "True"/"False"."""
    text_flags = [
        F.initcap(F.col(f.name).cast("string")).alias(f.name)
        if f.dataType.typeName() == "boolean"
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*text_flags).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, replacing what is there."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_serving(df: DataFrame, path: str) -> None:
    """Parquet serving table, replacing what is there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _folder(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop has them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


#: Spark allows as many.
MOST_BUCKETS = 100_000


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a serving table, opened again; its shuffle files go once it is written."""
    with settings(df.sparkSession, WRITTEN):
        write_serving(df, path)
    return df.sparkSession.read.parquet(path)


def stored_by(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Like ``stored``, in buckets by a hash of the first column of ``by``, sorted by all of them.

    As many buckets as the session has shuffle partitions: joins and aggregates by that column then move no row
    of the table.  Buckets are known through a catalogue entry, which is dropped as soon as the table is open.
    """
    spark, name = df.sparkSession, f"spark_catalog.default.ledgerline_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    folder, system = _folder(spark, path)
    whole = system.makeQualified(folder).toString().replace("\\", "\\\\").replace("'", "\\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    layout = f"CLUSTERED BY ({by[0]}) SORTED BY ({', '.join(by)}) INTO {buckets} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') {layout} LOCATION '{whole}'")
    try:
        with settings(spark, WRITTEN):
            df.repartition(by[0]).write.insertInto(name, overwrite=True)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # an external one: its files stay


class Steps:
    """Steps of a chain as tables under ``path``, each planned and written when it is first asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.written = spark, path, {}

    def __call__(self, name: str, plan: Callable[[], DataFrame], *by: str) -> DataFrame:
        """The table ``name``, laid out by ``by`` if given."""
        if name not in self.written:
            frame, path = plan(), f"{self.path}/{name}"
            self.written[name] = stored_by(frame, path, *by) if by else stored(frame, path)
        return self.written[name]

    def drop(self, *names: str) -> None:
        """Delete tables whose rows nothing reads any more."""
        for name in names:
            if self.written.pop(name, None) is not None:
                folder, system = _folder(self.spark, f"{self.path}/{name}")
                system.delete(folder, True)


def write_parts(df: DataFrame, path: str, *by: str, options: Mapping[str, str] | None = None) -> None:
    """Parquet in a folder per value of ``by``, replacing what is there; read it with ``open_parts``, empty or not."""
    df.write.mode("overwrite").options(**{"compression": "zstd", **(options or {})}).partitionBy(*by).parquet(path)
    df.limit(0).write.parquet(f"{path}/_shape")


def open_parts(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_parts`` wrote."""
    return spark.read.schema(spark.read.parquet(f"{path}/_shape").schema).parquet(path)


def write_all(frames: Mapping[str, DataFrame], path: str, at_once: int = 4) -> None:
    """Several independent serving tables; their jobs share the cluster."""
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(write_serving, df, f"{path}/{name}") for name, df in frames.items()]
        for job in jobs:
            job.result()


def latest_per_key(df: DataFrame, key: str, version: Sequence[str]) -> DataFrame:
    """The row with the highest ``version`` tuple for each key.

    An aggregate rather than a ranking window: rows are combined before the
    shuffle, so a key with very many versions costs one row per map task.
    """
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(newest)
        .select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])
    )


def upsert_by_key(
    current: DataFrame | None, updates: DataFrame, key: str, version: Sequence[str] = ()
) -> DataFrame:
    """Each update replaces the current document of the same key; the rest stay.

    Of several updates of one key the highest ``version`` wins, ties by the
    other columns, so that any run picks the same.  Rows without a key can
    replace nothing and be replaced by nothing: they all stay.
    """
    generation = "_generation"
    both = updates.withColumn(generation, F.lit(1))
    if current is not None:
        both = current.withColumn(generation, F.lit(0)).unionByName(both)
    rest = [c for c in updates.columns if c != key and c not in version]
    newest = latest_per_key(both, key, [generation, *version, *rest])
    return newest.unionByName(both.filter(F.col(key).isNull())).drop(generation)


def publish(
    current: DataFrame | None, updates: DataFrame, key: str, path: str, version: Sequence[str] = ()
) -> None:
    """Write the merged snapshot to ``path``, a folder other than the current one.

    The first snapshot is merged like any other: updates of one key leave one row.
    """
    upsert_by_key(current, updates, key, version).write.mode("errorifexists").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append log entries stamped with the time of writing."""
    df.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def recent(df: DataFrame, time_column: str, tiebreak: str, limit: int = 20) -> DataFrame:
    """The most recent entries, newest first."""
    return df.orderBy(F.desc_nulls_last(time_column), F.asc(tiebreak)).limit(limit)
