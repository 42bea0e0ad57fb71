"""Loading a drop of exports: every key kept, bad lines set aside with their file, counts as a by-product."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import sinks
from ledgerline.sources.catalog import SOURCES, Source

#: Fields of one export outside its catalogue entry that may become columns; more are an error, not a cut.
MAX_FIELDS = 1000

_BROKEN = "_broken"
_LINE = ["_line", "_file", "_modified"]


@dataclass(frozen=True)
class Loaded:
    """``frames``: per export its catalogue fields and ``rest``, a map of all others; ``quarantine``: lines that are no
    JSON object, with their file; ``profile``: rows, columns and bad lines per export."""

    frames: dict[str, DataFrame]
    quarantine: DataFrame
    profile: DataFrame


def lines(spark: SparkSession, root: str, source: Source, files: str = "*.jsonl") -> DataFrame:
    """value, file and modified of every line that isn't blank; no rows where the folder doesn't exist."""
    path = f"{root.rstrip('/')}/{source.folder}"
    try:
        found = spark.read.option("pathGlobFilter", files).text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string, file string, modified timestamp")
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")]
    return found.filter(F.trim("value") != "").select("value", *meta)


def _fields(value: Column | str) -> Column:
    """All keys of a JSON object with their values as text, nested ones as JSON; NULL where there is no object."""
    return F.from_json(value, "map<string,string>", {"mode": "PERMISSIVE"})


def _parsed(found: DataFrame, source: Source) -> DataFrame:
    broken = F.col("m").isNull()
    rest = F.map_filter("m", lambda key, _: ~key.isin(*source.fields))
    aside = [F.when(broken, F.col(c)).alias(name) for c, name in zip(("value", "file", "modified"), _LINE)]
    return found.withColumn("m", _fields("value")).select(
        *[F.try_element_at("m", F.lit(f)).alias(f) for f in source.fields], rest.alias("rest"), *aside, broken.alias(_BROKEN)
    )


def load(
    spark: SparkSession,
    root: str,
    path: str,
    catalog: Mapping[str, Source] = SOURCES,
    files: str = "*.jsonl",
    at_once: int = 4,
) -> Loaded:
    """Write every export under ``path`` as Parquet and open it.

    Each export is read once: its lines are parsed once to a map of all keys,
    good rows and bad lines go to a folder each in the same write, and the
    profile is what Spark observes while writing.  An export without a folder
    has no rows.  Columns are text, as the cleaning operators expect.
    """
    counts = {name: Observation() for name in catalog}

    def write(name: str) -> None:
        rows = _parsed(lines(spark, root, catalog[name], files), catalog[name])
        seen = [F.count_if(~F.col(_BROKEN)).alias("row_count"), F.count_if(_BROKEN).alias("malformed")]
        sinks.write_parts(rows.observe(counts[name], *seen), f"{path}/{name}", _BROKEN)

    with ThreadPoolExecutor(at_once) as pool:
        for job in [pool.submit(write, name) for name in catalog]:
            job.result()
    opened = {name: sinks.open_parts(spark, f"{path}/{name}") for name in catalog}
    frames = {
        name: rows.filter(~F.col(_BROKEN)).select(*catalog[name].fields, "rest") for name, rows in opened.items()
    }
    profile = [(name, obs.get["row_count"], len(catalog[name].fields), obs.get["malformed"]) for name, obs in counts.items()]
    return Loaded(
        frames,
        _united([_aside(name, rows) for name, rows in opened.items()]),
        spark.createDataFrame(profile, "table_name string, row_count bigint, column_count bigint, malformed bigint"),
    )


def _aside(name: str, rows: DataFrame) -> DataFrame:
    line, file, modified = (F.col(c) for c in _LINE)
    return rows.filter(_BROKEN).select(
        F.lit(name).alias("export"), line.alias("line"), file.alias("file"), modified.alias("modified")
    )


def _united(frames: list[DataFrame]) -> DataFrame:
    first, *more = frames
    for frame in more:
        first = first.unionByName(frame)
    return first


def unknown_fields(frame: DataFrame) -> list[str]:
    """Names of the fields in ``rest``, in order; they come to the driver, as column names do."""
    keys = frame.select(F.explode(F.map_keys("rest")).alias("key")).distinct()
    names = sorted(row["key"] for row in keys.limit(MAX_FIELDS + 1).collect())
    if len(names) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields outside the catalogue")
    return names


def union_of_keys(frame: DataFrame) -> DataFrame:
    """``frame`` with a text column for every field of ``rest``: the union of the keys of all lines."""
    known = [c for c in frame.columns if c != "rest"]
    return frame.select(*known, *[F.try_element_at("rest", F.lit(n)).alias(n) for n in unknown_fields(frame)])


def drift(
    spark: SparkSession, root: str, catalog: Mapping[str, Source] = SOURCES, files: str = "*.jsonl"
) -> DataFrame:
    """Every field that occurs in a drop: export, field, known (in the catalogue), rows that have it, and the
    type all its values share; catalogue fields that no row has are listed with 0 rows."""
    parts = []
    for name, source in catalog.items():
        value = lines(spark, root, source, files).select(F.try_parse_json("value").alias("v"))
        each = value.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).filter("key IS NOT NULL")
        found = each.groupBy(F.col("key").alias("field")).agg(
            F.count(F.lit(1)).alias("rows"), F.schema_of_variant_agg("value").alias("type")
        )
        listed = spark.createDataFrame([(f,) for f in source.fields], "field string").withColumn("known", F.lit(True))
        both = found.join(listed, "field", "full")
        parts.append(
            both.select(
                F.lit(name).alias("export"),
                "field",
                F.coalesce("known", F.lit(False)).alias("known"),
                F.coalesce("rows", F.lit(0)).alias("rows"),
                "type",
            )
        )
    return _united(parts)
