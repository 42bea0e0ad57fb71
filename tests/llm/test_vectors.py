"""Nearest neighbours and lattice near-dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ann, lattice
from ledgerline.llm.work import Scratch

ROWS = "vec_id bigint, embedding array<float>, label int, list int, cell bigint"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v], 1, 2, 3) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, ROWS)


def searched(spark, df, k=20, **settings):
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, Scratch(spark, "t"), k, ann.Settings(**settings))
    rows = found.orderBy("query_id", "rank").collect()
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return rows


def brute(vectors, query, k, ids=None):
    v = np.array(vectors, np.float32).astype(float)
    ids = np.arange(len(v)) if ids is None else np.array(ids)
    at = int(np.flatnonzero(ids == query)[0])
    s = (v * v[at]).sum(1)
    return [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != at][:k]


def test_recall_and_order_on_random_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = searched(spark, frame(spark, v.tolist()), list_rows=64)
    hit = total = 0
    for q in range(0, 3000, 20):
        got = [r for r in rows if r.query_id == q]
        want = brute(v, q, 20)
        assert [r["rank"] for r in got] == list(range(1, 21))
        scores = dict(brute(v, q, 3000))
        assert all(r.score == pytest.approx(scores[r.vec_id], rel=1e-12) for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hit += len({r.vec_id for r in got} & {i for i, _ in want})
        total += 20
    assert hit / total >= 0.9


def test_lengths_of_many_sizes(spark):
    """Inner products favour long vectors; bands of length keep them findable."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 8)) * np.exp(rng.normal(0, 3, (600, 1)))
    rows = searched(spark, frame(spark, v.tolist()))
    hit = sum(
        len({r.vec_id for r in rows if r.query_id == q} & {i for i, _ in brute(v, q, 20)}) for q in range(0, 600, 20)
    )
    assert hit >= 0.9 * 20 * 30


def test_copies_ties_and_unusable_vectors(spark):
    same, nan = [1.0, 0.0], float("nan")
    v = [same] * 30 + [[0.0, 0.0], None, [nan, 1.0], [None, 1.0], [float("inf"), 1.0], [0.5, 0.5], [1.0]]
    rows = searched(spark, frame(spark, v))
    first = [r.vec_id for r in rows if r.query_id == 0]
    assert first == list(range(1, 21))
    assert [r.vec_id for r in rows if r.query_id == 20] == list(range(20))
    assert {r.query_id for r in rows} == {0, 20}


def test_fewer_candidates_repeated_rows_and_null_ids(spark):
    rows = searched(spark, frame(spark, [[1, 0], [1, 0], [0, 1], [1, 1]], [0, 0, 1, None]))
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 0.0)]
    assert searched(spark, frame(spark, [])) == []


def near(spark, df):
    out = lattice.near_copies(df, Scratch(spark, "t"))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}


def expected(v, ids):
    v = np.array(v, np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {i: (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(1), label)}


def test_near_copies_like_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    v = [*base, *base[:40], *(base[:20] * 3)]  # exact and scaled copies
    for i in range(60):  # a dense group of different vectors, and a chain
        v.append(base[0] + 0.02 * rng.normal(size=64))
        v.append(base[1 + i % 30] + 0.035 * rng.normal(size=64) * np.linalg.norm(base[1]) / 8)
    chain = base[100]
    for _ in range(8):
        step = rng.normal(size=64)
        chain = chain + 0.3 * np.linalg.norm(chain) * step / np.linalg.norm(step)
        v.append(chain)
    ids = rng.permutation(len(v)).tolist()
    rounded = np.array(v, np.float32)
    assert near(spark, frame(spark, rounded.tolist(), ids)) == expected(rounded, ids)


def test_large_cells_are_compared_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = (np.ones((300, 16)) + 0.01 * rng.normal(size=(300, 16))).astype(np.float32)
    settings = lattice.Settings(block=64)
    out = lattice.near_copies(frame(spark, v.tolist()), Scratch(spark, "t"), settings=settings).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(299, 0)}


def test_unusable_vectors_link_with_nothing(spark):
    nan = float("nan")
    v = [[1, 2], [1, 2], [0, 0], [0, 0], None, [nan, 1], [None, 1], [float("inf"), 0], [1], [2, 4]]
    got = near(spark, frame(spark, v))
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[9] == (2, 0, False)
    assert all(got[i] == (0, i, True) for i in range(2, 9))
    assert near(spark, frame(spark, [])) == {}
    assert near(spark, frame(spark, [[0, 0], None])) == {0: (0, 0, True), 1: (0, 1, True)}


def test_every_shared_cell_is_a_meeting_and_the_first_one_counts():
    rng = np.random.default_rng(8)
    cells = rng.integers(0, 9, (1000, 3, 4)) * 10 + np.arange(4)  # cells of a vector differ within a table
    for i in range(500):
        shared = [(t, c) for t in range(3) for c in sorted(set(cells[i, t]) & set(cells[500 + i, t]))]
        pair = np.full(len(shared), i), np.full(len(shared), 500 + i)
        tab, code = (np.array([x[k] for x in shared], np.int64) for k in (0, 1))
        counted = lattice._first_meeting(cells, *pair, tab, code)
        assert counted.tolist() == [True] * (len(shared) > 0) + [False] * (len(shared) - 1)


def test_pairs_at_the_limit_meet():
    """Pairs just above the limit share a cell, unrelated ones hardly ever."""
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a, side = unit(rng.normal(size=(1000, 64))), rng.normal(size=(1000, 64))
    side = unit(side - (side * a).sum(1)[:, None] * a)
    tables = lattice.Tables(64, lattice.Settings())

    def met(x, y):
        return (tables.cells(x)[:, :, :, None] == tables.cells(y)[:, :, None, :]).any((1, 2, 3)).mean()

    assert met(a, 0.9 * a + np.sqrt(1 - 0.81) * side) > 0.99
    assert met(a, side) < 0.005


def test_repeated_rows_and_rows_without_id(spark):
    v = [[1, 2, 0], [1, 2, 0], [1, 2, 0], [0, 0, 1], [1, 2, 0.01]]
    out = lattice.near_copies(frame(spark, v, [7, 7, None, 9, 8]), Scratch(spark, "t")).collect()
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in out)
    assert got == [(-1, 0, -1, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (9, 0, 9, True)]


def test_lattice_points_are_nearest():
    points = np.random.default_rng(7).normal(0, 2, (500, 8))
    found = lattice.nearest_point(points)
    assert len(lattice.NEIGHBOURS) == 240
    own = ((points - found) ** 2).sum(1)
    for step in lattice.NEIGHBOURS:
        assert (own <= ((points - found - step) ** 2).sum(1) + 1e-9).all()
