"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.work import Scratch


def _scrambled(df: DataFrame, source: str, target: str) -> DataFrame:
    """``target``: a bijective scrambling of the long ``source`` (shifts and xors never overflow)."""
    df = df.withColumn(target, F.col(source))
    for shift, bits in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
        df = df.withColumn(target, F.col(target).bitwiseXOR(shift(target, bits)))
    return df


def _edge(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def connected(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Columns (node, component) for every node of ``links`` (columns a, b, longs).

    The component is its smallest node.  In each round every node takes the name
    of its smallest neighbour, under a scrambled order of names so that chains
    shrink by a factor whatever their numbering, and links between equal names
    vanish.  Each round's names and links are written tables, nothing is
    collected, and rounds grow with the logarithm of the longest chain.  Loops
    and repeated links are allowed; links with a null end are ignored; no links
    give no rows.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    mixed = _scrambled(_scrambled(links, "a", "p"), "b", "q")
    first = scratch.write(mixed, f"{name}-links")
    edges = first.filter("p != q").select(*_edge(F.col("p"), F.col("q"))).distinct()
    renamings, done = [], 0
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select("v", "u"))
        names = both.groupBy("u").agg(F.min("v").alias("m"))
        names = names.select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        renaming = scratch.write(names, f"{name}-names-{done}")
        renamings.append(renaming)
        left = renaming.select(F.col("node").alias("u"), F.col("to").alias("pu"))
        right = renaming.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        shrunk = edges.join(left, "u").join(right, "v").filter("pu != pv")
        edges = scratch.write(
            shrunk.select(*_edge(F.col("pu"), F.col("pv"))).distinct(), f"{name}-edges-{done}"
        )
        if done:
            scratch.drop(f"{name}-edges-{done - 1}")
        done += 1
    nodes = first.select(F.col("a").alias("node"), F.col("p").alias("key"))
    nodes = nodes.union(first.select("b", "q")).distinct()
    if not renamings:
        return nodes.select("node", F.col("node").alias("component"))
    labels = renamings[-1].select("node", F.col("to").alias("label"))
    for renaming in reversed(renamings[:-1]):
        later = labels.withColumnRenamed("node", "to")
        labels = renaming.join(later, "to", "left").select(
            "node", F.coalesce("label", "to").alias("label")
        )
    labels = labels.withColumnRenamed("node", "key")
    named = scratch.write(
        nodes.join(labels, "key", "left").select("node", F.coalesce("label", "key").alias("label")),
        f"{name}-labels",
    )
    scratch.drop(f"{name}-links", *[f"{name}-names-{i}" for i in range(done)], f"{name}-edges-{done - 1}")
    smallest = named.groupBy("label").agg(F.min("node").alias("component"))
    return named.join(smallest, "label").select("node", "component")
