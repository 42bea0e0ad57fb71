"""Filter interaction audit: what each filter of a cascade removes, in every order they may run in.

Documents are counted once by the set of filters they fail, a mask.  All orders
are then played through per mask, in higher-order functions, so the work on
documents doesn't depend on how many orders there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.work import Scratch

#: The filters, smallest bit of a mask first.
FILTERS = "ABCDE"

#: White space between words.
SPACE = r"[ \t\n\x0B\f\r]+"

#: Failure conditions: fewer words; share of distinct words and of capitals, in percent; characters of markup.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"

#: A text is looked up in a broadcast if one of so many rows has it; there can't be more such texts than this.
HOT = 1000

#: What is counted of a filter at its step.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def _bits(conditions: Sequence[Column]) -> Column:
    flags = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]
    return reduce(lambda a, b: a + b, flags).cast("int")


def masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part (the language, empty if null) and mask, one row per document.

    Filters A to D look at a text alone: too few words, too few distinct ones,
    too many capitals, markup.  E fails a text that stands under a smaller id
    anywhere in the table.  Null texts are empty ones; documents without an id
    have no smaller id and are nobody's; rows with equal id and text don't fail
    one another.  Texts are read once; a text is compared by its SHA-256, whose
    smallest id is an aggregate combined before the shuffle.  Texts that hold a
    share of 1 / HOT of all rows, HOT at most, are looked up in a broadcast, so
    that no task gets all rows of one; the others are joined.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    chars = F.char_length("text")
    capitals = chars - F.char_length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    alone = [
        words < LEAST_WORDS,
        distinct.cast("long") * 100 < words.cast("long") * LEAST_DISTINCT,
        capitals.cast("long") * 100 > chars.cast("long") * MOST_CAPITALS,
        F.col("text").rlike(MARKS),
    ]
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    read = scratch.write(own.select("doc_id", "part", _bits(alone).alias("alone"), digest), "read")
    copied = read.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")
    )
    copied = scratch.write(copied.filter("first < last").drop("last"), "copied")
    share = F.col("n") * HOT >= F.lit(read.count())
    hot, others = (copied.filter(c).select("digest", "first") for c in (share, ~share))
    spread = read.join(F.broadcast(hot), "digest")
    rest = read.join(F.broadcast(hot), "digest", "left_anti").join(others, "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("alone") + F.when(copy, 1 << len(alone)).otherwise(0)
    return spread.unionByName(rest).select("doc_id", "part", mask.cast("int").alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and mask: part, mask, n, good, toxic.

    A document is good or toxic if any label row of its id says so; a null
    label, or none, says nothing.
    """
    said = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")]
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*said)
    rows = masked.join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic")
    )


def _played(cell: Column, orders: Column) -> Column:
    """One cell folded across all orders: a struct of weighted counts per order and step.

    Within an order the fold carries whether an earlier filter has removed the
    cell's documents.
    """
    zero = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        gone, taken = state["gone"], fails & ~state["gone"]
        row = F.struct(
            F.when(gone | fails, zero).otherwise(cell["n"]).alias("kept"),
            F.when(taken, cell["n"]).otherwise(zero).alias("removed"),
            F.when(fails & gone, cell["n"]).otherwise(zero).alias("redundant"),
            F.when(cell["mask"] == bit, cell["n"]).otherwise(zero).alias("unique_fails"),
            F.when(taken, cell["good"]).otherwise(zero).alias("good_lost"),
            F.when(taken, cell["toxic"]).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["rows"], F.array(row)).alias("rows"))

    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<struct<{fields}>>").alias("rows"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["rows"])))


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from ``cells``.

    Columns: part, filter_order, step (from 1), filter, and counts of the part's
    documents: kept after the step; removed by it; redundant, those that fail
    the filter and went earlier; unique_fails, those that fail no other filter;
    good_lost and toxic_lost, the removed that are labelled so; shapley, the
    filter's removed added up over all orders.  Parts without documents don't
    exist, so no rows give none.

    A part has one cell per mask, two to the number of filters at most, however
    many documents: cells are merged by adding their structs up place by place.
    All orders are listed, so this is for a handful of filters.
    """
    # as one literal each: the plan stays small
    listed = F.split(F.lit(" ".join("".join(order) for order in permutations(filters))), " ")
    places = F.sequence(F.lit(1), F.lit(len(filters)))

    def letter(order: Column, place: Column) -> Column:
        return F.substring(order, place, F.lit(1))

    def bit(order: Column, place: Column) -> Column:
        return F.pow(F.lit(2), F.instr(F.lit(filters), letter(order, place)) - 1).cast("int")

    def head(order: Column, place: Column) -> Column:
        return F.struct(order.alias("filter_order"), place.alias("step"), letter(order, place).alias("filter"))

    orders = F.transform(listed, lambda order: F.transform(places, lambda place: bit(order, place)))
    heads = F.flatten(F.transform(listed, lambda order: F.transform(places, lambda place: head(order, place))))

    nothing = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])

    def sums(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    per_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    merged = F.aggregate(
        "cells",
        F.array_repeat(nothing, len(filters) * factorial(len(filters))),
        lambda total, cell: F.zip_with(total, _played(cell, orders), sums),
    )
    rows = F.arrays_zip(heads.alias("head"), F.col("counts"))

    def removed(f: str) -> Column:
        add = lambda total, row: total + F.when(row["head"]["filter"] == f, row["counts"]["removed"]).otherwise(0)
        return F.aggregate("rows", F.lit(0).cast("long"), add)

    totals = F.create_map(*[part for f in filters for part in (F.lit(f), removed(f))])
    played = per_part.select("part", merged.alias("counts")).select("part", rows.alias("rows"))
    played = played.select("part", totals.alias("shapley"), F.explode("rows").alias("row"))
    shapley = F.col("shapley")[F.col("row.head.filter")].alias("shapley")
    return played.select("part", "row.head.*", *[F.col(f"row.counts.{c}") for c in COUNTS], shapley)


def document_filters(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(cells(masks(docs, scratch), labels))
