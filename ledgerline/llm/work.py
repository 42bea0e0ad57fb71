"""Tables written between the steps of one operator, in the folder all executors share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it, if the folder exists there."""
    root = str(Path(__file__).resolve().parents[2])
    settings = spark.sparkContext.environment
    paths = [p for p in settings.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        settings["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def free(columns: list[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores ahead as it takes to be none of ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """A folder of one operator run.

    It lies under ``spark.checkpoint.dir``; where that is unset, under the
    warehouse, which executors share as well.  Results may be read lazily from
    it, so the folder goes when the application ends; a table no longer needed
    goes earlier with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        application = spark.sparkContext.applicationId
        self.spark = importable(spark)
        self.path = f"{base.rstrip('/')}/ledgerline-llm/{application}/{name}-{uuid.uuid4().hex[:12]}"
        self._fs(self.path).deleteOnExit(self._path(self.path))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and opened again: its lineage ends here."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables whose rows nothing reads any more."""
        for name in names:
            path = f"{self.path}/{name}"
            self._fs(path).delete(self._path(path), True)
