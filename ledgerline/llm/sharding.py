"""Sharding by rendezvous hashing over weighted shards, in native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seed of the shard draws; another value deals all records anew.
SEED = 20_240_229

#: Sub-ranges a shard's records are numbered in; each is one window.
RANGES = 1024


def _score(keys: Sequence[Column], shard: int, weight: float, seed: int) -> Column:
    """The draw of one shard: an exponential variate of rate ``weight``, negated.

    The hash's top 52 bits give a uniform number strictly between 0 and 1.
    """
    draw = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard), F.lit(seed)), 12)
    uniform = (draw.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.ln(uniform) / F.lit(float(weight))


def shard_of(keys: Sequence[Column], weights: Mapping[int, float], seed: int = SEED) -> Column:
    """The shard whose draw is highest, so a record's shard depends on its key and the weights only.

    A shard holds a share of the keys in proportion to its weight.  Adding a
    shard moves to it only the keys whose new draw beats all old ones; removing
    one moves only its own keys.  Null keys are a key like any other.  Shards of
    weight zero or less get nothing; ties go to the smaller shard.
    """
    best, chosen = None, None
    draws = [
        F.struct(_score(keys, shard, weight, seed).alias("s"), F.lit(-shard).alias("n"))
        for shard, weight in sorted(weights.items())
        if weight > 0
    ]
    if not draws:
        raise ValueError("at least one shard needs a positive weight")
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    chosen = -best["n"]
    return chosen.cast("int")


def assign(
    df: DataFrame, keys: Sequence[str], weights: Mapping[int, float], to: str = "shard", seed: int = SEED
) -> DataFrame:
    """``df`` with column ``to``: the record's shard.  A narrow step without shuffle.

    Every row stays as it is, repeated rows and rows with nulls included; a
    column already named ``to`` is replaced.
    """
    return df.withColumn(to, shard_of([df[k] for k in keys], weights, seed))


def number(df: DataFrame, shard: str, columns: Sequence[str], to: str = "slot") -> DataFrame:
    """Rows of ``columns`` numbered from 0 without gaps within each shard.

    Equal rows are counted first and told apart last, so a row that repeats
    without end is one line on the way; the rest spread over ranges of a hash,
    numbered each by itself, with the sizes of the earlier ranges added.
    """
    columns = list(dict.fromkeys([shard, *columns]))
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_range", F.pmod(F.xxhash64(*columns), F.lit(RANGES)))
    totals = rows.groupBy(F.col(shard).alias("_s"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_t"))
    earlier = F.sum("_t").over(_window("_s").orderBy("_r").rowsBetween(_first(), -1))
    starts = totals.select("_s", "_r", F.coalesce(earlier, F.lit(0)).alias("_start"))
    before = F.sum("_n").over(_window(shard, "_range").orderBy(*columns).rowsBetween(_first(), -1))
    placed = rows.withColumn("_before", F.coalesce(before, F.lit(0)))
    at = [F.col(shard).eqNullSafe(F.col("_s")), F.col("_range") == F.col("_r")]
    placed = placed.join(starts, at)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    placed = placed.select(*columns, (F.col("_start") + F.col("_before")).alias("_from"), copies.alias("_i"))
    return placed.select(*columns, (F.col("_from") + F.col("_i")).alias(to))


def _window(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def _first() -> int:
    from pyspark.sql import Window

    return Window.unboundedPreceding


def document_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents by id over equal shards: where each lies now, and with one shard more.

    Size is the text's UTF-8 length plus 8.  A null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    now = {i: 1.0 for i in range(shards)}
    own = assign(own, ["doc_id"], now, "shard")
    own = assign(own, ["doc_id"], now | {shards: 1.0}, "grown_shard")
    out = number(own, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
