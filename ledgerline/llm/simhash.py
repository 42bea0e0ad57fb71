"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart share a variant that lies within r / 2
bits of both.  Every distinct fingerprint therefore goes to all variants within
that distance and meets its partners there.  The shuffle carries a variant by
its leading bits only: one row per reachable prefix instead of one per variant,
and the task that owns a prefix lists the variants below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import connected
from ledgerline.llm.work import Scratch, free

BITS = 64

#: Shingles hashed together, so that a very long text needs no more memory than its words.
PART = 1 << 16

#: Variants sorted together in one task, and rows of a prefix beyond which it is dealt on by more bits.
VARIANTS, ROWS = 1 << 21, 1 << 18


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The fingerprint of a whole text, unsigned.

    A-Z become lower case, words are runs without ASCII white space, shingles
    are ``size`` words joined by one space with repeats counted, or all words if
    there are fewer; their XXH64 vote on every bit, which is set if it is set in
    over half of them.  Null texts and texts without words give zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    size = min(size, len(words))
    ends = ends[size - 1 :] - 1
    starts = starts[: len(ends)]
    hashed, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(ends), PART):
        pairs = zip(starts[at : at + PART].tolist(), ends[at : at + PART].tolist())
        h = np.array([hashed(joined[a:b], seed) for a, b in pairs], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(ends)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str, to: str, size: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without its text but with its fingerprint as a signed long."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.array([fingerprint(t, size, seed) for t in frame[text]], np.uint64)
            yield frame.drop(columns=text).assign(**{to: found.view(np.int64)})

    rest = [f for f in docs.schema.fields if f.name != text]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{to}` bigint"])
    return docs.mapInPandas(add, fields)


def _deal(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    """Rows (prefix, depth, fp, left) dealt on by ``bits`` more bits, to every prefix within reach."""
    masks = [
        (sum(1 << (bits - 1 - i) for i in flipped), n)
        for n in range(radius + 1)
        for flipped in combinations(range(bits), n)
    ]
    reach = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("cost")) for m, n in masks]))
    below = rows.select("*", reach.alias("r")).filter("r.cost <= left")
    # the next ``bits`` bits of the fingerprint after ``depth``
    own = F.expr(f"shiftrightunsigned(shiftleft(fp, depth), {BITS - bits})")
    prefix = F.shiftleft("prefix", bits).bitwiseOR(own.bitwiseXOR(F.col("r.mask")))
    return below.select(
        prefix.alias("prefix"),
        (F.col("depth") + bits).alias("depth"),
        "fp",
        (F.col("left") - F.col("r.cost")).alias("left"),
    )


def _variants(fp: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants of ``fp`` within ``left`` flips below the first ``depth`` bits, and whose they are."""
    free = BITS - depth
    masks = [np.zeros(1, np.uint64)]
    single = np.uint64(1) << np.arange(free, dtype=np.uint64)
    for n in range(1, int(left.max()) + 1):
        sets = list(combinations(range(free), n))
        if sets:
            masks.append(np.bitwise_or.reduce(single[np.array(sets)], axis=1))
    out, owner = [], []
    for n, mask in enumerate(masks):
        who = np.flatnonzero(left >= n)
        out.append((fp[who][:, None] ^ mask[None, :]).ravel())
        owner.append(np.repeat(who, len(mask)))
    return np.concatenate(out), np.concatenate(owner)


def _met(fp: np.ndarray, left: np.ndarray, at: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (index, index) of rows that share a variant: each with the first row at that variant.

    ``at`` is a row's own prefix position: its fingerprint moved into this
    prefix.  Too many variants at once are halved by the next bit first.
    """
    free = BITS - depth
    each = [1, free, free * (free - 1) // 2]
    total = sum(int((left >= n).sum()) * (each[n] if n < 3 else free**n) for n in range(int(left.max()) + 1))
    if total > VARIANTS and free > 8 and len(fp) > 1:
        bit = np.uint64(1 << (free - 1))
        for side in (np.uint64(0), bit):
            stays = (at & bit) == side
            keep = stays | (left > 0)
            if keep.sum() > 1:
                moved = np.where(stays, at, at ^ bit)[keep]
                spent = np.where(stays, left, left - 1)[keep]
                index = np.flatnonzero(keep)
                for a, b in _met(fp[keep], spent, moved, depth + 1):
                    yield index[a], index[b]
        return
    variants, owner = _variants(at, left, depth)
    order = np.argsort(variants)
    variants, owner = variants[order], owner[order]
    new = np.concatenate(([True], variants[1:] != variants[:-1]))
    if not new.all():
        first = owner[np.flatnonzero(new)[np.cumsum(new) - 1]]
        pairs = np.unique(np.stack([first[~new], owner[~new]], axis=1), axis=0)
        yield pairs[:, 0], pairs[:, 1]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """The pairs that join two trees not joined before; the others say nothing new."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[y] = x
                kept.append((a, b))
    return kept


def links(fingerprints: DataFrame, scratch: Scratch, bits: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within ``bits``.

    Every link is verified by its bit count; of several ways from one
    fingerprint to another inside a task only a spanning forest leaves it.
    """
    radius = (bits + 1) // 2
    distinct = scratch.write(fingerprints.select("fp").distinct(), "fingerprints")
    variants = distinct.count() * sum(1 for n in range(radius + 1) for _ in combinations(range(BITS), n))
    first = min(24, max(1, (variants // VARIANTS).bit_length()))
    rows = distinct.select(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), "fp", F.lit(radius).alias("left"))
    rows = _deal(rows, first, radius)
    per = ["depth", "prefix"]
    for _ in range((BITS - first) // 8):
        crowded = rows.groupBy(*per).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS)
        if crowded.isEmpty():
            break
        further = _deal(rows.join(crowded.drop("n"), per, "left_semi"), 8, radius)
        rows = scratch.write(rows.join(crowded, per, "left_anti").select(*further.columns).union(further), f"deal-{_}")

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        depth, prefix = int(key[0]), int(key[1])
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(fp)
        fp, left = fp[order], frame["left"].to_numpy(np.int64)[order]
        below = (1 << (BITS - depth)) - 1
        at = (fp & np.uint64(below)) | np.uint64((prefix << (BITS - depth)) & ((1 << BITS) - 1))
        found = np.array(_forest(len(fp), _met(fp, left, at, depth)), np.int64).reshape(-1, 2)
        a, b = fp[found[:, 0]], fp[found[:, 1]]
        near = np.bitwise_count(a ^ b) <= bits
        return pd.DataFrame({"a": a[near].view(np.int64), "b": b[near].view(np.int64)})

    return rows.groupBy(*per).applyInPandas(meet, "a bigint, b bigint")


def _grouped(docs: DataFrame, scratch: Scratch, size: int, bits: int, seed: int) -> DataFrame:
    """doc_id, print (hash of the text), fp and component (a fingerprint) of every document row."""
    own = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    found = scratch.write(with_fingerprints(own, "text", "fp", size, seed), "documents")
    edges = scratch.write(links(found, scratch, bits), "edges")
    parts = connected(edges, scratch).withColumnRenamed("node", "fp")
    return found.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def groups(docs: DataFrame, scratch: Scratch, size: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document row.

    The component is the smallest doc_id reachable over links of at most
    ``bits`` differing bits.  Texts without words have fingerprint zero and link
    like any other.  Null ids get their component as others do but never name
    one unless no id of the component is set; repeated rows stay.
    """
    found = scratch.write(_grouped(docs, scratch, size, bits, seed), "grouped")
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "component").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def deduplicated(docs: DataFrame, scratch: Scratch, size: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """One document of each group, with all its columns: the one of the smallest id, null ids last.

    Of rows that share that id the one with the smallest hash of its text stays,
    and of rows equal in both the smallest by all columns.
    """
    found = _grouped(docs, scratch, size, bits, seed)
    key = free(docs.columns, "_none", "_id", "_print")
    parts = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))]
    order = F.struct(*[c.alias(name) for c, name in zip([*parts, F.col("print")], key)])
    kept = scratch.write(found.groupBy("component").agg(F.min(order).alias("first")).select("first.*"), "kept")
    keyed = docs.withColumns(dict(zip(key, [*parts, F.xxhash64("text")])))
    rows = keyed.join(kept, key, "left_semi")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    return rows.groupBy(*key).agg(F.min(whole).alias("row")).select("row.*")
