"""Nearest neighbours by inner product over balanced posting lists.

Vectors lie in lists around centroids; those near a boundary lie in several.
The centroids are few enough for the memory of every task and are searched by a
graph.  A query reads the lists whose centroids are not much farther than the
nearest one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.work import Scratch


@dataclass(frozen=True)
class Settings:
    """Lists hold about ``list_rows`` vectors, up to ``most_lists`` lists in all; centroids are fitted
    to ``sample`` vectors at most; a vector lies in up to ``copies`` lists whose centroid is at most
    ``border`` times as far as its nearest; a query reads lists up to ``reach`` times as far as the
    nearest centroid, ``least`` lists at least; ``block`` rows of a list meet ``block`` queries in a task."""

    list_rows: int = 256
    most_lists: int = 4096
    sample: int = 32_768
    copies: int = 3
    border: float = 1.05
    reach: float = 1.14
    least: int = 8
    block: int = 512
    degree: int = 12


def usable(vector: Column) -> Column:
    """Whether a vector can take part: no null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def balanced_centroids(points: np.ndarray, lists: int, rounds: int = 4) -> np.ndarray:
    """Centroids of ``lists`` clusters of nearly equal size.

    The points are halved along their widest direction until each part is one
    cluster; some rounds of assignment follow, in which full clusters look farther away.
    """
    parts, centroids = [(points, lists)], []
    while parts:
        own, n = parts.pop()
        if n <= 1 or len(own) <= 1:
            centroids.append(own.mean(0))
            continue
        spread = own - own.mean(0)
        direction = spread[np.argmax((spread**2).sum(1))]
        for _ in range(6):
            direction = spread.T @ (spread @ direction)
            length = np.linalg.norm(direction)
            if not length:
                break
            direction = direction / length
        order = np.argsort(spread @ direction, kind="stable")
        cut = max(1, len(own) * (n // 2) // n)
        parts += [(own[order[cut:]], n - n // 2), (own[order[:cut]], n // 2)]
    found = np.array(centroids)
    full = np.zeros(len(found))
    for _ in range(rounds):
        far = _distances(points, found)
        mean = far.min(1).mean()
        nearest = np.argmin(far + full[None, :] * mean, axis=1)
        sizes = np.bincount(nearest, minlength=len(found))
        full = np.clip(full + 0.1 * (sizes * len(found) / len(points) - 1), -0.5, 0.5)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, rows of a by rows of b."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0.0)


class CentroidGraph:
    """Centroids linked to their nearest ones, and each to the nearest before it so that all are reachable."""

    def __init__(self, centroids: np.ndarray, degree: int):
        self.centroids = centroids
        linked: list[set[int]] = [set() for _ in centroids]
        for start in range(0, len(centroids), 1024):
            far = _distances(centroids[start : start + 1024], centroids)
            for row, i in zip(far, range(start, start + len(far))):
                row[i] = np.inf
                near = np.argsort(row, kind="stable")[:degree]
                if i:
                    near = np.append(near, np.argmin(row[:i]))
                for j in near.tolist():
                    if j != i:
                        linked[i].add(j)
                        linked[j].add(i)
        self.linked = [np.array(sorted(x), np.int64) for x in linked]

    def search(self, query: np.ndarray, reach: float, least: int) -> list[int]:
        """Centroids at most ``reach`` times as far as the nearest one found, and the ``least`` nearest.

        The walk goes from the nearest known centroid to its links and ends when
        the next lies beyond the reach of the best.
        """
        c = self.centroids
        far = {0: float(((c[0] - query) ** 2).sum())}
        heap, best, done = [(far[0], 0)], far[0], 0
        while heap:
            distance, at = heapq.heappop(heap)
            if distance > best * reach**2 and done >= 4 * least:
                break
            done += 1
            new = [j for j in self.linked[at].tolist() if j not in far]
            if new:
                found = ((c[new] - query) ** 2).sum(1)
                for j, d in zip(new, found.tolist()):
                    far[j] = d
                    best = min(best, d)
                    heapq.heappush(heap, (d, j))
        order = sorted(far, key=lambda j: (far[j], j))
        return [j for i, j in enumerate(order) if i < least or far[j] <= best * reach**2]


@dataclass
class Band:
    """Vectors of similar length: their greatest length, first list number and centroids."""

    top: float
    first: int
    graph: CentroidGraph


def _band(norm):
    """Lengths of one band differ by a factor of two at most; length one lies well inside its band."""
    return np.floor(np.log2(norm) + 0.5).astype(int)


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors scaled by the band's greatest length, with one more component that makes all unit vectors:
    the nearest to (q / |q|, 0) is then the one with the largest inner product."""
    scaled = vectors / top
    return np.concatenate([scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))[:, None]], axis=1)


class Index:
    """Bands by number, each with its lists; small enough to broadcast: ``most_lists`` centroids at most."""

    def __init__(self, sample: np.ndarray, bands: list[tuple[int, int, float]], settings: Settings):
        self.bands: dict[int, Band] = {}
        self.settings = settings
        norms = _band(np.linalg.norm(sample, axis=1)) if len(sample) else np.zeros(0, int)
        total, first = sum(n for _, n, _ in bands), 0
        for number, n, top in sorted(bands):
            own = sample[norms == number]
            if not len(own):
                own = np.zeros((1, sample.shape[1]))
            own = _lifted(own, top)
            most = max(1, settings.most_lists * n // max(total, 1))
            lists = max(1, min(math.ceil(n / settings.list_rows), most, len(own)))
            self.bands[number] = Band(top, first, CentroidGraph(balanced_centroids(own, lists), settings.degree))
            first += lists

    def assign(self, vectors: np.ndarray) -> list[list[int]]:
        """The lists of each vector: its nearest, and for one near a boundary the others about as near."""
        out: list[list[int]] = [[] for _ in vectors]
        numbers = _band(np.linalg.norm(vectors, axis=1))
        for number in np.unique(numbers).tolist():
            band = self.bands[number]
            rows = np.flatnonzero(numbers == number)
            centroids = band.graph.centroids
            far = _distances(_lifted(vectors[rows], band.top), centroids)
            near = np.argsort(far, axis=1, kind="stable")[:, : self.settings.copies]
            for row, own, order in zip(rows.tolist(), far, near):
                limit = own[order[0]] * self.settings.border**2
                chosen = [j for j in order.tolist() if own[j] <= limit]
                out[row] = [band.first + j for j in chosen]
        return out

    def lists(self, query: np.ndarray) -> list[int]:
        """The lists a query reads, in every band."""
        unit = np.append(query / np.linalg.norm(query), 0.0)
        s = self.settings
        return [b.first + j for b in self.bands.values() for j in b.graph.search(unit, s.reach, s.least)]


def _placed(classes: DataFrame, index: Index, queries: bool) -> DataFrame:
    """Rows (list, class_id, vec): where vectors lie, or which lists they read as queries."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors = np.stack(frame["vec"].to_numpy()).astype(float)
                found = [shared.value.lists(q) for q in vectors] if queries else shared.value.assign(vectors)
                at = np.repeat(np.arange(len(frame)), [len(x) for x in found])
                rows = frame.iloc[at].reset_index(drop=True)
                yield rows.assign(list=np.concatenate(found))[["list", "class_id", "vec"]]

    return classes.select("class_id", "vec").mapInPandas(run, "list int, class_id bigint, vec array<double>")


def _blocks(rows: DataFrame, size: int, ids: str, vectors: str) -> DataFrame:
    """Rows of a list packed into blocks of about ``size``: a long list is several blocks."""
    per = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    rows = rows.join(per, "list")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class_id"), "parts"))
    packed = F.collect_list(F.struct("class_id", "vec")).alias("packed")
    rows = rows.groupBy("list", "part").agg(packed)
    return rows.select("list", F.col("packed.class_id").alias(ids), F.col("packed.vec").alias(vectors))


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in one order whatever the number of rows."""
    return (queries * rows).sum(axis=-1)


def _ranked(found: list[tuple[np.ndarray, ...]], keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` best of each query among (query, row, score) columns; a row found twice counts once."""
    query, row, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    new = np.ones(len(query), bool)  # equal rows of a query have equal scores and so lie together
    new[1:] = (query[1:] != query[:-1]) | (row[1:] != row[:-1])
    query, row, score = query[new], row[new], score[new]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    best = place < keep
    return query[best], row[best], score[best]


def _best(met: DataFrame, keep: int, most: int = 1 << 20) -> DataFrame:
    """Of the rows (a block of a list, a block of queries) of a task: the best ``keep`` classes of each query.

    What blocks find is merged as the task goes on, so a task gives ``keep`` rows
    for a query however many lists it read; never more than about ``most`` wait
    in memory, beyond which the merged ones are given out.
    """

    def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
        return column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def block(one: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        own = one.column("rows").flatten().to_numpy(zero_copy_only=False)
        asked = one.column("queries").flatten().to_numpy(zero_copy_only=False)
        vectors, wanted = one.column("row_vecs"), one.column("query_vecs")
        dims = len(wanted.flatten().flatten()) // len(asked)
        p, q = matrix(vectors, dims), matrix(wanted, dims)
        order = np.argsort(own)
        own, p = own[order], p[order]
        about = q @ p.T
        some = min(len(own), keep + 8)
        picked = np.argpartition(-about, some - 1, axis=1)[:, :some]
        score = exact_scores(q[:, None, :], p[picked])
        # the best first, ties to the smaller class
        best = np.lexsort((own[picked], -score), axis=1)[:, :keep]
        across = np.arange(len(asked))[:, None]
        return np.repeat(asked, best.shape[1]), own[picked][across, best].ravel(), score[across, best].ravel()

    def given(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(c) for c in _ranked(found, keep)]
        yield pa.RecordBatch.from_arrays(columns, names=["query_class", "class_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                found.append(block(batch.slice(i, 1)))
                waiting += len(found[-1][0])
                if waiting > 2 * most:
                    found = [_ranked(found, keep)]
                    waiting = len(found[0][0])
                    if waiting > most:
                        yield from given(found)
                        found, waiting = [], 0
        if found:
            yield from given(found)

    return met.mapInArrow(run, "query_class bigint, class_id bigint, score double")


def nearest(
    rows: DataFrame, is_query: Column, scratch: Scratch, k: int = 20, settings: Settings = Settings()
) -> DataFrame:
    """The ``k`` rows of largest inner product for each query row, as far as its lists hold them.

    ``rows`` has vec_id and embedding; ``is_query`` tells queries among them.
    Returns query_id, rank from 1, vec_id and score; ties go to the smaller
    vec_id; a query is never its own neighbour; fewer candidates give fewer
    rows.  Vectors that are null, zero, hold null or non-finite components or
    have another length than most take no part, neither do rows without id;
    equal rows count once.  Equal vectors are searched once, and of each only
    the k + 1 smallest ids can ever be among the k nearest.
    """
    own = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), is_query.alias("asks"))
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    dims = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    own = own.filter(F.size("vec") == dims["n"])
    first = Window.partitionBy("vec").orderBy("vec_id")
    ids = own.select("vec_id", "vec").distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    classes = ids.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.write(classes.withColumn("class_id", F.col("ids")[0]), "classes")
    asked = own.filter("asks").select(F.col("vec_id").alias("query_id"), "vec").distinct()
    asked = scratch.write(asked.join(classes.select("vec", "class_id"), "vec").select("query_id", "class_id"), "asked")

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    measured = classes.select(norm.alias("norm")).withColumn("band", F.floor(F.log2("norm") + 0.5))
    bands = measured.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()
    sample = classes.select("class_id", "vec").orderBy(F.xxhash64("class_id"), "class_id").limit(settings.sample)
    points = sample.select("vec").toArrow().column("vec").combine_chunks()
    points = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims["n"])
    index = Index(points, [(int(b["band"]), b["n"], b["top"]) for b in bands], settings)

    lists = _blocks(_placed(classes, index, queries=False), settings.block, "rows", "row_vecs")
    asking = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi")
    probes = _blocks(_placed(asking, index, queries=True), settings.block, "queries", "query_vecs")
    found = _best(lists.join(probes, "list").drop("list"), k + 1).distinct()
    per = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("place", F.row_number().over(per)).filter(F.col("place") <= k + 1)
    found = found.join(classes.select("class_id", "ids"), "class_id")
    found = found.select("query_class", "score", F.explode("ids").alias("vec_id"))
    per = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(per)).filter(F.col("place") <= k + 1).drop("place")
    found = asked.join(found, asked["class_id"] == found["query_class"]).filter("vec_id != query_id")
    per = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(per)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
