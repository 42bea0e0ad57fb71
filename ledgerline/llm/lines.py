"""Line dedup: like lines found by MinHash over character shingles, one of each group kept."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.components import connected
from ledgerline.llm.work import Scratch, free

#: Characters in a shingle.  A line of fewer is one shingle, so it is like lines that differ in case only.
SHINGLE = 9

#: Lines are alike if the sets of their shingles have at least this Jaccard similarity.
ALIKE = 0.8

#: Bands and hashes in each: two lines at the threshold share a band in 995 of 1000 cases.
BANDS, EACH = 10, 4

#: Lines of a bucket compared in one task; larger buckets go to several, pair of chunks by pair.
CHUNK = 512

#: Lines of small buckets compared in one group, about.
TOGETHER = 4096

#: Classes of shingles counted for each line, a power of two.
TALLY = 1024

#: Bytes of text split at once.
PIECE = 1 << 22

#: Characters hashed together, small enough for the processor's cache.
CHARS = 1 << 16

#: Bits of the map that tells lines worth another look: 8 MB, whatever the corpus.
MAP_BITS = 1 << 26

_RNG = np.random.default_rng(20_240_131)
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * EACH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BLEND = _RNG.integers(0, 1 << 63, (BANDS, EACH), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def _minima(codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The smallest value of each hash over the shingles of each line: lines by hashes.

    ``cuts`` has where the shingles of a line begin and end, line after line.
    """
    base = np.uint32(0x9E3779B1)
    power, h, n = base, codes * np.uint32(0x01000193) + np.uint32(1), len(codes)
    out, width, filled = None, 1, 0
    for bit in range(SHINGLE.bit_length()):
        if SHINGLE >> bit & 1:  # windows of ``filled`` characters, then ``width`` more
            if out is None:
                out = h.copy()
            else:
                out[: n - filled] = out[: n - filled] * power + h[filled:][: n - filled]
            filled += width
        longer = h.copy()
        longer[: n - width] = h[: n - width] * power + h[width:]
        h, power, width = longer, np.uint32(int(power) ** 2 & 0xFFFFFFFF), 2 * width
    out = np.append(_mixed(out), np.uint32(0))
    found, turned = np.empty((len(_FACTORS), len(cuts) // 2), np.uint32), np.empty_like(out)
    for row, factor in zip(found, _FACTORS):  # odd factors permute the mixed values
        np.multiply(out, factor, out=turned)
        row[:] = np.minimum.reduceat(turned, cuts)[::2]
    return found.T


def band_keys(lines: list[str]) -> np.ndarray:
    """A long for each band of each line (lines by BANDS); every line has at least one whole shingle.

    A very long line is hashed in stretches that overlap by a shingle less one character.
    """
    pieces, owner = [], []
    for i, line in enumerate(map(str.lower, lines)):
        for at in range(0, max(1, len(line) - SHINGLE + 1), CHARS):
            pieces.append(line[at : at + CHARS + SHINGLE - 1])
            owner.append(i)
    minima = np.full((len(lines), len(_FACTORS)), np.uint32(0xFFFFFFFF), np.uint32)
    start = 0
    while start < len(pieces):
        end, chars = start, 0
        while end < len(pieces) and (end == start or chars + len(pieces[end]) <= CHARS):
            chars += len(pieces[end])
            end += 1
        codes = np.frombuffer("".join(pieces[start:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) for p in pieces[start:end]])
        begins = np.cumsum(lengths) - lengths
        cuts = np.stack([begins, begins + lengths - SHINGLE + 1], axis=1).ravel()
        np.minimum.at(minima, np.array(owner[start:end]), _minima(codes, cuts))
        start = end
    by_band = minima.reshape(-1, BANDS, EACH).astype(np.uint64)
    keys = np.zeros(by_band.shape[:2], np.uint64)
    for j in range(EACH):
        keys = (keys ^ by_band[:, :, j]) * _BLEND[:, j][None, :]
        keys ^= keys >> np.uint64(31)
    return (keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _short_key(line: str) -> int:
    digest = hashlib.blake2b(line.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def shingles(line: str) -> set[str]:
    line = line.lower()
    if len(line) < SHINGLE:
        return {line}
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def similarity(a: set, b: set) -> float:
    """The exact Jaccard similarity of two sets that aren't both empty."""
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``PIECE`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // PIECE
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for first, last in zip(edges, edges[1:]):
            if first < last:
                yield batch.slice(first, last - first)


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Every line of ``texts`` that isn't blank: row of its text, number (from 0), key, spelled.

    spelled is the line without white space at its ends; key its XXH64.  Lines
    that differ in case only have different keys but the same shingles.
    """
    parts = pc.split_pattern(texts, "\n")
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    sizes = np.bincount(owner, minlength=len(texts))
    number = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    spelled = pc.ascii_trim(pc.list_flatten(parts), characters=" \t\r\x0b\x0c")
    solid = np.flatnonzero(pc.binary_length(spelled).to_numpy(zero_copy_only=False))
    spelled = spelled.take(pa.array(solid))
    hashes = (xxhash.xxh64_intdigest(line, 42) for line in spelled.cast(pa.binary()).to_pylist())
    keys = np.fromiter(hashes, np.uint64, len(solid)).view(np.int64)
    return owner[solid], number[solid].astype(np.int32), keys, spelled


def _line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of all lines in a row, and where those of each begin and end; one key for a short line."""
    short = np.array([len(line.lower()) < SHINGLE for line in lines], bool)  # lower-casing may change the length
    cuts = np.concatenate([[0], np.cumsum(np.where(short, 1, BANDS))])
    flat = np.empty(cuts[-1], np.int64)
    flat[cuts[:-1][short]] = [_short_key(line) for line, s in zip(lines, short) if s]
    places = cuts[:-1][~short][:, None] + np.arange(BANDS)
    flat[places] = band_keys([line for line, s in zip(lines, short) if not s])
    return flat, cuts


def _signed(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: doc_id, print (hash of the text), line (from 0), key, bands.

    bands has the line's band keys at the first line of a key in a run of texts,
    and is null at others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            owner, number, keys, spelled = _split(batch.column("text"))
            first = np.sort(np.unique(keys, return_index=True)[1])
            flat, cuts = _line_keys(spelled.take(pa.array(first)).to_pylist())
            at = np.full(len(keys), -1)
            at[first] = np.arange(len(first))
            rows = pa.ListArray.from_arrays(cuts.astype(np.int32), flat).take(pa.array(at, mask=at < 0))
            own = [batch.column(name).take(pa.array(owner)) for name in ("doc_id", "print")]
            names = ["doc_id", "print", "line", "key", "bands"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(number), pa.array(keys), rows], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    return own.mapInArrow(run, f"doc_id {id_type}, print bigint, line int, key bigint, bands array<bigint>")


def _spelled(docs: DataFrame) -> DataFrame:
    """key and spelled of every line that isn't blank, once in a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            _, _, keys, spelled = _split(batch.column("text"))
            first = np.sort(np.unique(keys, return_index=True)[1])
            lines = spelled.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), lines], names=["key", "spelled"])

    return docs.select("text").mapInArrow(run, "key bigint, spelled string")


def _worth_a_look(found: DataFrame, keys: DataFrame) -> DataFrame:
    """key and spelled, once each, of the lines whose key is among ``keys``.

    A bit map of bounded size, built from the keys and broadcast, keeps most
    other lines out of the shuffle; the join that follows is exact.
    """
    place = F.shiftrightunsigned("key", 64 - MAP_BITS.bit_length() + 1)
    maps = keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    numbers = F.sequence(F.lit(0), (F.length("map") / 8).cast("int") - 1)

    def word(i: Column) -> Column:
        return F.conv(F.hex(F.substring(F.col("map"), i * 8 + 1, F.lit(8))), 16, -10).cast("long")

    maps = maps.select("part", F.transform(numbers, word).alias("words"))
    marked = found.withColumn("at", place).withColumn("part", F.bitmap_bucket_number("at"))
    marked = marked.join(F.broadcast(maps), "part").withColumn("bit", F.bitmap_bit_position("at"))
    # bit b of byte j is bit 56 - 8 j + b of a word of eight bytes
    in_word = (F.col("bit").bitwiseXOR(F.lit(56).cast("long")) % 64).cast("int")
    marked = marked.filter(F.getbit(F.get("words", F.shiftright("bit", 6).cast("int")), in_word) == 1)
    # not a semi join, which would be moved ahead of the map
    return marked.join(keys.distinct(), "key").groupBy("key").agg(F.first("spelled").alias("spelled"))


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all lines as 64-bit hashes, and where those of each line begin, line after line.

    Two of a few hundred shingles having one hash is out of the question, so sets of hashes stand for the sets.
    """
    spelled = list(map(str.lower, lines))
    codes = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(line) for line in spelled], np.int64)
    windows = max(0, len(codes) - SHINGLE + 1)
    h = np.zeros(windows, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ codes[i : i + windows]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(spelled)), sizes)[:windows]
    within = np.arange(windows) + SHINGLE <= ends[owner]
    return h[within], np.concatenate([[0], np.cumsum(np.maximum(0, sizes - SHINGLE + 1))])


def _coded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of ``_windows``, each once per line and in order, and where those of each line begin, line after line."""
    h, starts = _windows(lines)
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        h[start:end].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[starts[:-1][np.diff(starts) > 0]] = True
    return h[first], np.concatenate([[0], np.cumsum(first)])[starts]


def _similarities(lines: list[str], centers: list[str], at: list[int]) -> list[float]:
    """The exact similarity of each line and ``centers[i]``, i being the number ``at`` has for it."""
    (h, starts), (known, begins) = ([x.tolist() if i else x for i, x in enumerate(_coded(t))] for t in (lines, centers))
    out = []
    for line, i, start, end in zip(lines, at, starts, starts[1:]):
        begin, stop = begins[i], begins[i + 1]
        if start == end or begin == stop:
            out.append(similarity(shingles(line), shingles(centers[i])))
            continue
        both = np.concatenate([h[start:end], known[begin:stop]])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(shared / (len(both) - shared))
    return out


def _compared(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, a_spelled, b_spelled) with their exact similarity instead of the spelling."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for first in range(0, len(whole), 1024):
                frame = whole.iloc[first : first + 1024]
                at, centers = pd.factorize(frame["b_spelled"])
                found = _similarities(frame["a_spelled"].tolist(), list(centers), at.tolist())
                yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "similarity": found})

    return pairs.mapInPandas(run, "a bigint, b bigint, similarity double")


def _tallies(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each line fall into each of ``TALLY`` classes: lines by classes.

    The smaller counts of two lines, added up, are no less than the hashes they share.
    """
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    classes = (hashes >> np.uint64(64 - TALLY.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(owner * TALLY + classes, minlength=n * TALLY)
    return counts.astype(np.min_scalar_type(counts.max(initial=0))).reshape(n, TALLY)


def _among(frame: pd.DataFrame) -> pd.DataFrame:
    """Links among members of buckets that don't both link to their center.

    A pair is compared only in the first bucket it shares, and only if its
    tallies leave room for enough shared shingles.  Distances 1 - similarity obey
    the triangle inequality, so members whose distances from the center differ by
    more than the limit can't be alike either, nor can sets of too different
    sizes.  Members already joined need no comparison.
    """
    frame = frame.sort_values("band", kind="stable", ignore_index=True)
    n, band, bands = len(frame), frame["band"].to_numpy(), frame["bands"].tolist()
    keys, far, chunk = frame["key"].tolist(), (1 - frame["similarity"]).to_numpy(), frame["chunk"].to_numpy()
    apart = frame["left"].iloc[0] != frame["right"].iloc[0]
    near = far <= 1 - ALIKE
    hashes, starts = _coded(frame["spelled"].tolist())
    sizes, tallies = np.diff(starts), _tallies(hashes, starts)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    edges = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), n]
    for first, last in zip(edges, edges[1:]):
        linked = (np.flatnonzero(near[first:last]) + first).tolist()
        for i in linked[1:]:
            root[i] = linked[0]
        sets: dict[int, set[int]] = {}
        for i in range(first + 1, last):
            if not sizes[i]:
                continue
            size, met = sizes[first:i], np.abs(far[first:i] - far[i]) <= 1 - ALIKE + 1e-9
            met &= np.minimum(size, sizes[i]) >= ALIKE * np.maximum(size, sizes[i]) - 1e-9
            if near[i]:
                met &= ~near[first:i]
            if apart:
                met &= chunk[first:i] != chunk[i]
            met = np.flatnonzero(met) + first
            if not len(met):
                continue
            most = np.minimum(tallies[met], tallies[i]).sum(axis=1, dtype=np.int64)
            mine = set(bands[i].tolist())
            for j in met[(1 + ALIKE) * most >= ALIKE * (sizes[met] + sizes[i]) - 1e-6].tolist():
                if min(mine.intersection(bands[j].tolist())) < band[i]:
                    continue
                x, y = find(i), find(j)
                if x == y:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = set(hashes[starts[k] : starts[k + 1]].tolist())
                if similarity(sets[i], sets[j]) >= ALIKE:
                    root[y] = x
                    out.append((keys[i], keys[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def like_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines of ``_signed`` without bands, with ``component``: equal for lines connected by likeness.

    Buckets are lines that share a band.  Each member is first held against the
    bucket's smallest key, its center: a pair that meets in many bands is one
    pair.  Members that don't all link to the center are then compared among
    themselves.  Both comparisons are exact; a pair of lines that shares a band
    is never left unconnected if it is alike.
    """
    signed = scratch.write(_signed(docs), "signed")
    members = signed.filter("bands IS NOT NULL").select(F.explode("bands").alias("band"), "key")
    per = Window.partitionBy("band")
    members = members.withColumn("center", F.min("key").over(per)).withColumn("last", F.max("key").over(per))
    shared = members.filter("center != last AND key != center").select("band", "key", "center").distinct()
    shared = scratch.write(shared, "shared")
    pairs = scratch.write(shared.select(F.col("key").alias("a"), F.col("center").alias("b")).distinct(), "pairs")
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
    spelled = scratch.write(_worth_a_look(_spelled(docs), keys), "spelled")
    first = spelled.withColumnsRenamed({"key": "a", "spelled": "a_spelled"})
    second = spelled.withColumnsRenamed({"key": "b", "spelled": "b_spelled"})
    # joined by center last, so that its pairs come together
    compared = scratch.write(_compared(pairs.join(first, "a").join(second, "b")), "compared")

    # Who isn't alike the center, but near enough that a line alike both may exist, is held against
    # the center's like; who isn't even near, only against the others that aren't alike.
    wide = shared.join(compared.withColumnsRenamed({"a": "key", "b": "center"}), ["key", "center"])
    other, border = F.col("similarity") < ALIKE, F.col("similarity").between(2 * ALIKE - 1 - 1e-9, ALIKE - 1e-12)
    mark = F.sum(F.pmod(F.xxhash64("key", "center"), F.lit(1 << 40))).alias("mark")
    todo = wide.groupBy("band", "center").agg(
        F.count(F.lit(1)).alias("m"), mark, F.count_if(other).alias("others"), F.max(border).alias("bordered")
    )
    todo = todo.filter("m > 1 AND (others > 1 OR bordered)")
    # buckets with the same members and center need one look
    todo = todo.groupBy("center", "m", "mark", "others", "bordered").agg(F.min("band").alias("band"))
    todo = scratch.write(todo, "todo")
    # small buckets share a group, large ones have several of their own
    tasks = todo.select(F.ceil(F.sum("m") / TOGETHER).alias("tasks")).first()["tasks"] or 1
    rest = wide.join(todo.select("band", "m", "bordered"), "band").filter(other | F.col("bordered"))
    chunks = F.ceil(F.col("m") / CHUNK)
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    rest = rest.withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    known = shared.groupBy("key").agg(F.collect_set("band").alias("bands")).join(spelled, "key")
    rest = rest.join(known, "key").select("m", "band", "left", "right", "chunk", "key", "similarity", "bands", "spelled")
    group = F.when(F.col("m") > CHUNK, F.xxhash64("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(tasks)))
    among = rest.withColumn("group", group).drop("m").groupBy("group", "left", "right").applyInPandas(_among, "a bigint, b bigint")

    edges = compared.filter(F.col("similarity") >= ALIKE).select("a", "b").union(among)
    edges = scratch.write(edges, "edges")
    scratch.drop("shared", "pairs", "spelled", "compared", "todo")
    parts = connected(edges, scratch).withColumnRenamed("node", "key")
    named = signed.drop("bands").join(parts, "key", "left")
    return named.withColumn("component", F.coalesce("component", "key"))


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines to take away: doc_id, print, and their numbers as an array.

    Of each component the first line stays, by document id (null last), hash of
    the text and number.
    """
    named = scratch.write(like_lines(docs, scratch), "named")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "print", "line")
    firsts = named.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = scratch.write(firsts, "firsts")
    # components of a thousandth of all lines, a thousand at most, are looked up; no task gets all lines of one
    often = F.col("n") * 1000 >= F.lit(named.count())
    hot, others = F.broadcast(firsts.filter(often)), firsts.filter(~often)
    later = named.join(hot, "component").unionByName(named.join(hot, "component", "left_anti").join(others, "component"))
    later = later.filter(~order.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "print").agg(F.collect_set("line").alias("gone"))


def cleaned(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Every row of ``docs`` with its text less repeated lines, and lines_before, lines_after.

    Rows with equal id and text are one document and keep the same lines; null
    texts stay null with no lines, empty ones have one; blank lines always stay;
    columns so named are replaced.
    """
    id_, print_, gone_, text_ = free(docs.columns, "_id", "_print", "_gone", "_text")
    gone = repeated(docs, scratch).toDF(id_, print_, gone_)
    same = [docs["doc_id"].eqNullSafe(gone[id_]), F.xxhash64(docs["text"]) == gone[print_]]
    rows = docs.join(gone, same, "left")

    def without(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    # inside a lambda, so that a text is split once
    rest = F.transform(F.array(F.split("text", "\n", -1)), without)[0]
    breaks = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    before = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long")
    after = before - F.coalesce(F.size(gone_), F.lit(0))
    after = F.when(F.col(gone_).isNull(), before).otherwise(after)
    rows = rows.withColumn(text_, F.when(F.col(gone_).isNull(), F.col("text")).otherwise(rest))
    kept = [c for c in docs.columns if c not in ("text", "lines_before", "lines_after")]
    return rows.select(
        *[docs[c] for c in kept], F.col(text_).alias("text"), before.alias("lines_before"), after.alias("lines_after")
    )


def deduplicated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with repeated lines taken away, columns as before; documents that lost lines and have
    no others but blank ones go: they lie whole elsewhere."""
    found = cleaned(docs, scratch)
    left = (F.col("lines_after") == F.col("lines_before")) | (F.length(F.btrim("text", F.lit(" \t\r\n"))) > 0)
    new = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    kept = found.filter(left | F.col("text").isNull())
    return kept.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
