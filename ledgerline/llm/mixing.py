"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks.

All native.  Every document gets its place in the word stream of its source;
the stream is cut into blocks of equal length; sources get whole numbers of
blocks by highest quotients, shard by shard; a seeded walk over the blocks of a
source gives each shard the next blocks, as many as its quota says.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.work import Scratch, free

WORD = r"[^\x20\x09-\x0D]+"

GAP = r"[\x20\x09-\x0D]"

#: Stride of the scattered walk, a prime; times the blocks of 10^13 words it still fits a long.
STRIDE = 7_368_787

#: Documents numbered together in one window.
TOGETHER = 4_096


@dataclass(frozen=True)
class Recipe:
    """weights repeat over the sources in code-point order, null last; ``share`` is the mix's size
    in sizes of the corpus; a source is taken at most ``most`` times; the mix is cut into blocks of
    ``block`` words, at any size of the input, dealt to ``shards``; a source's last pass takes every
    ``stride``-th block in a ring (every one, where the stride divides their number).  With 1 it takes one run of the stream, so all documents but the two at its ends are
    taken whole or not at all, whatever the length of a block."""

    weights: Sequence[int] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block: int = 16
    shards: int = 8
    seed: int = 17
    stride: int = STRIDE


def words(text: str = "text") -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A number of 32 bits that depends on ``parts`` alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per source: sid, source, source_size, docs, weight, target (words, double).

    ``sizes`` has source and size.  Targets follow the weights; what exceeds
    ``most`` times a source's size goes to the others by weight until none is
    above.  The windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    listed = F.array(*[F.lit(w) for w in recipe.weights])
    weight = F.element_at(listed, ((F.col("sid") - 1) % len(recipe.weights) + 1).cast("int"))
    per = per.withColumn("sid", rank).withColumn("weight", weight.cast("double"))
    whole = Window.partitionBy()
    cap = F.col("source_size").cast("double") * recipe.most
    per = per.withColumn("cap", cap).withColumn("turn", F.col("cap") / F.col("weight"))
    per = per.withColumn("goal", F.sum("source_size").over(whole) * F.lit(recipe.share))
    earlier = Window.orderBy("turn", "sid").rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    per = per.withColumn("level", (F.col("goal") - full) / (F.sum("weight").over(whole) - gone))
    level = F.max(F.when(F.col("level") < F.col("turn"), F.col("level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    per = per.withColumn("target", target)
    return per.select("sid", "source", "source_size", "docs", "weight", "goal", "target")


def quotas(sources: DataFrame, recipe: Recipe) -> DataFrame:
    """Blocks of each source in each shard: columns sid, shard (from 0), quota, and upto (quota so far).

    Sainte-Lague gives the first h blocks to the h highest quotients
    target / (2k + 1), ties to the earlier source.  Seats once given stay when h
    grows, so a shard's quota is what its end adds to its start.  A divisor that
    surely gives too little settles all but about one seat per source; only
    those are ranked.
    """
    rows = sources.select("sid", "target", F.round(F.col("goal") / recipe.block).cast("long").alias("all"))
    rows = rows.withColumn("shard", F.explode(F.array(*[F.lit(i) for i in range(recipe.shards)])))
    house = F.floor(F.col("all") * (F.col("shard") + 1) / recipe.shards).cast("long")
    per = Window.partitionBy("shard")
    half = F.count(F.when(F.col("target") > 0, 1)).over(per) / F.lit(2)
    rows = rows.withColumn("house", house).withColumn("half", half)
    rows = rows.withColumn("sum", F.sum("target").over(per))

    def seats(of_house: Column, nudge: float) -> Column:
        share = F.when(F.col("sum") > 0, F.col("target") / F.col("sum") * of_house).otherwise(0.0)
        return F.floor(F.greatest(share, F.lit(0.0)) + F.lit(0.5 + nudge)).cast("long")

    rows = rows.withColumn("sure", F.greatest(F.lit(0), seats(F.col("house") - F.col("half"), -1e-6)))
    rows = rows.withColumn("upto", F.when(F.col("target") > 0, seats(F.col("house") + F.col("half"), 1e-6) + 1))
    rows = rows.withColumn("open", F.col("house") - F.sum("sure").over(per))
    seat = F.explode(F.sequence(F.col("sure"), F.greatest(F.col("sure"), F.col("upto"))))
    doubtful = rows.filter("target > 0").select("sid", "shard", "target", "open", seat.alias("k"))
    quotient = F.col("target") / (F.col("k") * 2 + 1)
    place = F.row_number().over(per.orderBy(quotient.desc(), "sid", "k"))
    won = doubtful.withColumn("place", place).filter("place <= open")
    won = won.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("won"))
    rows = rows.join(won, ["sid", "shard"], "left")
    rows = rows.withColumn("upto", F.col("sure") + F.coalesce("won", F.lit(0)))
    earlier = F.lag("upto", 1, 0).over(Window.partitionBy("sid").orderBy("shard"))
    return rows.select("sid", "shard", (F.col("upto") - earlier).alias("quota"), "upto")


def plan(docs: DataFrame, recipe: Recipe, scratch: Scratch) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, and the mix's choice.

    start: the document's first word in its source's stream; block: words in a
    block; n: blocks of the source; ends: for each shard, where in the source's
    walk its blocks end; whole: complete passes; rest: blocks of the last pass;
    shift: where the walk begins; stride: its step; print: hash of the text.  Texts are read once.  The order of documents
    in a stream is a seeded draw on id and size, then the hash, so equal rows are
    interchangeable and reruns agree.
    """
    own = docs.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("print"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    own = own.withColumn("draw", _draw(F.lit(recipe.seed), key, F.col("size")))
    sizes = scratch.write(own, "sizes")
    sources = scratch.write(targets(sizes, recipe), "sources")
    dealt = quotas(sources, recipe).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("dealt"))
    per = sources.join(dealt, "sid").withColumn("block", F.lit(recipe.block).cast("long"))
    per = per.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))))
    most = F.col("n") * recipe.most
    per = per.withColumn("ends", F.transform("dealt", lambda d: F.least(d["upto"], most)))
    per = per.withColumn("quota", F.element_at("ends", -1))
    stride = F.when(F.col("n") % recipe.stride == 0, 1).otherwise(recipe.stride)
    shift = F.pmod(_draw(F.lit(recipe.seed), F.col("sid")), F.col("n"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("docs") / TOGETHER))
    per = per.select(
        "sid",
        F.col("source").alias("s_source"),
        "source_size",
        "target",
        "block",
        "n",
        "ends",
        F.floor(F.col("quota") / F.col("n")).alias("whole"),
        (F.col("quota") % F.col("n")).alias("rest"),
        shift.alias("shift"),
        stride.cast("long").alias("stride"),
        ranges.alias("ranges"),
    )
    rows = sizes.join(per, sizes["source"].eqNullSafe(per["s_source"])).drop("s_source")
    rows = rows.withColumn("range", F.floor(F.col("draw") * F.col("ranges") / F.lit(1 << 32)))
    totals = rows.groupBy("sid", "range").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "range").orderBy("draw", "doc_id", "size", "print")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, ["sid", "range"])
    return rows.withColumn("start", F.col("offset") + F.col("ahead")).drop("offset", "ahead", "range", "ranges")


def _place(b: Column) -> Column:
    """Turn of block ``b`` in the seeded walk over its source's blocks."""
    return F.pmod(b * F.col("stride") + F.col("shift"), F.col("n"))


def _ends() -> tuple[Column, Column]:
    """The blocks of a document's first and last word."""
    first = F.floor(F.col("start") / F.col("block")).cast("long")
    return first, F.floor((F.col("start") + F.col("size") - 1) / F.col("block")).cast("long")


def _blocks(wanted: Column) -> Column:
    """The blocks of a document with words, where ``wanted``."""
    first, last = _ends()
    return F.when((F.col("size") > 0) & wanted, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _from(b: Column) -> Column:
    return F.greatest(F.lit(0), b * F.col("block") - F.col("start"))


def _upto(b: Column) -> Column:
    return F.least(F.col("size"), (b + 1) * F.col("block") - F.col("start"))


def dealt() -> Column:
    """Words of a planned row that the mix takes for the shards up to each, repeats counted.

    The walk passes block b at its place, and again ``n`` places later on each
    further pass; a shard ends at a place of the walk.
    """

    def passes(b: Column, end: Column) -> Column:
        return F.floor((end - _place(b) + F.col("n") - 1) / F.col("n"))

    def upto(end: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate(_blocks(F.lit(True)), zero, lambda sofar, b: sofar + (_upto(b) - _from(b)) * passes(b, end))

    return F.transform("ends", upto)


def spans() -> Column:
    """Word spans (begin, end; end excluded) of the last, partial pass, in order; adjoining blocks are one span."""
    first, last = _ends()
    blocks = _blocks(F.col("rest") > 0)
    begins = F.filter(blocks, lambda b: (_place(b) < F.col("rest")) & ((b == first) | (_place(b - 1) >= F.col("rest"))))
    ends = F.filter(blocks, lambda b: (_place(b) < F.col("rest")) & ((b == last) | (_place(b + 1) >= F.col("rest"))))
    return F.zip_with(begins, ends, lambda b, e: F.struct(_from(b).alias("begin"), _upto(e).alias("end")))


def mix(docs: DataFrame, scratch: Scratch, recipe: Recipe = Recipe()) -> DataFrame:
    """Every document row with its size and how many of its words the mix takes, in all and for each
    shard (``shard_words``, comma-joined).

    Null texts and texts without words have size 0 and are taken 0 times; null
    sources are a source; repeated rows are planned each; no rows give none.
    """
    rows = plan(docs, recipe, scratch).withColumn("sofar", dealt())
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("sofar"))
    each = F.transform("sofar", lambda w, i: (w - F.get(before, i)).cast("string"))
    taken, shard_words = F.element_at("sofar", -1), F.array_join(each, ",")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), shard_words.alias("shard_words"))


def mixed_texts(docs: DataFrame, scratch: Scratch, recipe: Recipe = Recipe()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per complete pass over a document,
    unchanged, and one per span of the last pass, with the white space it has in the document.

    Documents that the mix doesn't take at all go, as do those without words.
    Rows of one id and text share one plan.
    """
    rows = plan(docs, recipe, scratch).select("doc_id", "source", "print", F.struct("start", "whole", spans().alias("spans")).alias("plan"))
    once = rows.groupBy("doc_id", "source", "print").agg(F.min("plan").alias("plan"))
    own_, words_, id_, source_, print_, whole_, spans_, pieces_, text_ = free(
        docs.columns, "_own", "_words", "_id", "_source", "_print", "_whole", "_spans", "_pieces", "_text"
    )
    once = once.select("doc_id", "source", "print", "plan.whole", "plan.spans").toDF(id_, source_, print_, whole_, spans_)
    own = docs.withColumns({words_: words(), own_: F.xxhash64("text")}).filter(F.col(words_) > 0)
    same = [own["doc_id"].eqNullSafe(once[id_]), own["source"].eqNullSafe(once[source_])]
    both = own.join(once, [*same, own[own_] == once[print_]])

    def uncut(s: Column) -> Column:
        return (s["begin"] == 0) & (s["end"] == F.col(words_))

    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"{GAP}*{WORD}"), F.lit(0))
    both = both.withColumn(pieces_, F.when(F.exists(spans_, lambda s: ~uncut(s)), pieces))

    def part(s: Column) -> Column:
        cut = F.array_join(F.slice(pieces_, s["begin"] + 1, s["end"] - s["begin"]), "")
        cut = F.when(s["begin"] > 0, F.regexp_replace(cut, f"^{GAP}+", "")).otherwise(cut)
        return F.when(uncut(s), F.col("text")).otherwise(cut)

    copies = F.array_repeat(F.col("text"), F.col(whole_).cast("int"))
    texts = both.withColumn(text_, F.explode(F.concat(copies, F.transform(spans_, part))))
    n_chars = F.char_length(text_).cast("long")
    new = {"text": F.col(text_), "n_chars": n_chars}
    return texts.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
