"""Keyed snapshots published in part: only buckets that an update touches are read and written again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.sinks import latest_per_key

BUCKET = "_bucket"


@dataclass(frozen=True)
class Snapshot:
    """The latest row of every key under ``path``, in ``buckets`` folders by a hash of the key.

    An update reads and replaces the folders its keys fall into and leaves the
    others, files and all, as they are.  Choose the number of buckets so that
    one holds about a gigabyte: work per update is the touched buckets, and
    never less than one.  Rows without a key replace nothing and are replaced by
    nothing; each publication adds them in a folder of their own.

    One publication at a time.  The merged buckets are written aside first; if
    the job is lost while they are put in place, the next call of ``publish`` or
    ``recover`` puts them in place again before anything else.  Readers may see
    some buckets before and some after while that lasts.
    """

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 256) -> Snapshot:
        """An empty snapshot; what it is like is written beside it, so that ``open`` needs the path alone."""
        if key not in schema.names or BUCKET in schema.names:
            raise ValueError(f"{key} must be a column, {BUCKET} must not")
        layout = spark.range(1).select(
            F.lit(key).alias("key"), F.lit(buckets).alias("buckets"), F.lit(schema.json()).alias("columns")
        )
        layout.write.mode("errorifexists").json(f"{path}/_layout")
        return cls(spark, path, key, schema, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Snapshot:
        """A snapshot that ``create`` made."""
        layout = spark.read.schema("key string, buckets int, columns string").json(f"{path}/_layout").first()
        return cls(spark, path, layout["key"], T.StructType.fromJson(json.loads(layout["columns"])), layout["buckets"])

    def _all(self) -> DataFrame:
        columns = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.StringType())])
        try:
            return self.spark.read.schema(columns).parquet(f"{self.path}/rows")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], columns)

    def rows(self) -> DataFrame:
        """All rows, in the columns the snapshot was made with."""
        return self._all().select(*self.schema.names)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """``df`` with the folder of each row's key."""
        at = F.format_string("k%06d", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))
        return df.withColumn(BUCKET, at)

    def of_key(self, value: object) -> DataFrame:
        """The row of one key; opens the one folder it can be in."""
        wanted = F.lit(value).cast(self.schema[self.key].dataType)
        at = F.format_string("k%06d", F.pmod(F.xxhash64(wanted), F.lit(self.buckets)))
        return self._all().filter((F.col(BUCKET) == at) & (F.col(self.key) == wanted)).select(*self.schema.names)

    def publish(self, updates: DataFrame, version: Sequence[str] = ()) -> list[str]:
        """Merge ``updates`` and return the buckets they touched.

        Of several updates of one key the highest ``version`` wins, ties by the
        other columns; it replaces the current row whatever its version.
        Updates are reduced to a row per key first, combined before the
        shuffle, so a key with very many versions is a row per task; they and
        the current rows of their buckets then meet in one shuffle by bucket.
        The touched buckets, at most ``buckets`` names, come to the driver to
        prune the scan.
        """
        self.recover()
        staged = f"{self.path}/_staged"
        updates = updates.select(*self.schema.names)
        rest = [c for c in self.schema.names if c != self.key and c not in version]
        newest = self._bucketed(latest_per_key(updates, self.key, [*version, *rest]))
        newest.write.mode("overwrite").parquet(f"{self.path}/_updates")
        newest = self.spark.read.schema(newest.schema).parquet(f"{self.path}/_updates")
        touched = sorted(row[0] for row in newest.select(BUCKET).distinct().collect())
        current = self._all().filter(F.col(BUCKET).isin(touched))
        both = current.withColumn("_new", F.lit(False)).unionByName(newest.withColumn("_new", F.lit(True)))
        row = F.struct(*[c for c in self.schema.names if c != self.key])
        merged = both.repartition(BUCKET).groupBy(BUCKET, self.key).agg(F.max_by(row, "_new").alias("_row"))
        merged = merged.select(BUCKET, self.key, "_row.*").select(*self.schema.names, BUCKET)
        keyless = updates.filter(F.col(self.key).isNull()).withColumn(BUCKET, F.lit(f"none-{uuid.uuid4().hex}"))
        merged.unionByName(keyless).write.mode("overwrite").partitionBy(BUCKET).parquet(staged)
        self.recover()
        return touched

    def recover(self) -> bool:
        """Put buckets in place that a publication wrote aside; whether there were any.

        May be repeated: it replaces whole buckets by what was written.
        """
        staged = f"{self.path}/_staged"
        if not self._exists(f"{staged}/_SUCCESS"):
            return False
        columns = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.StringType())])
        rows = self.spark.read.schema(columns).parquet(staged)
        into = rows.repartition(BUCKET).sortWithinPartitions(BUCKET, self.key).write.mode("overwrite")
        into.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        self._remove(staged)
        self._remove(f"{self.path}/_updates")
        return True

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        found, files = self._path(path)
        return files.exists(found)

    def _remove(self, path: str) -> None:
        found, files = self._path(path)
        files.delete(found, True)

