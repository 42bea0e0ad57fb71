"""Keyed snapshots: what an update reads, replaces and leaves alone."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import sinks
from ledgerline.sources.snapshots import BUCKET, Snapshot

DDL = "id string, version bigint, value string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "rows").rglob("*.parquet")}


@pytest.fixture
def snapshot(spark, tmp_path):
    made = Snapshot.create(spark, str(tmp_path / "s"), "id", frame(spark, []).schema, buckets=16)
    made.publish(frame(spark, [(f"k{i}", 1, "old") for i in range(400)] + [(None, 1, "a"), (None, 2, "a")]))
    return made


def values(snapshot):
    return {r.id: (r.version, r.value) for r in snapshot.rows().collect() if r.id is not None}


def test_untouched_buckets_keep_their_files(spark, snapshot):
    before = files(snapshot.path)
    touched = snapshot.publish(frame(spark, [("k3", 2, "new"), ("k3", 1, "late"), ("k7", 9, "new"), ("more", 1, "x")]), ["version"])
    after = files(snapshot.path)
    assert 1 <= len(touched) <= 3
    kept = {p for p in before if not any(f"{BUCKET}={b}/" in p for b in touched)}
    assert kept and all(after[p] == before[p] for p in kept)
    assert not any(p in after for p in set(before) - kept)
    got = values(snapshot)
    assert len(got) == 401 and got["k3"] == (2, "new") and got["k7"] == (9, "new") and got["k4"] == (1, "old")


def test_merge_reads_touched_buckets_only(spark, snapshot):
    plan = snapshot.of_key("k3")._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{BUCKET}#\d+ = k0", plan)
    assert [tuple(r) for r in snapshot.of_key("k3").collect()] == [("k3", 1, "old")]
    assert snapshot.of_key("nobody").collect() == []


def test_equals_the_whole_upsert(spark, snapshot):
    current = snapshot.rows()
    updates = frame(spark, [(f"k{i % 50}", i, f"v{i % 7}") for i in range(0, 300, 3)] + [(None, 5, "b"), ("k1", None, None)])
    expected = sinks.upsert_by_key(current, updates, "id", ["version"]).collect()
    snapshot.publish(updates, ["version"])
    assert sorted(map(repr, snapshot.rows().collect())) == sorted(map(repr, expected))


def test_rows_without_key_are_added_once(spark, snapshot):
    before = files(snapshot.path)
    assert snapshot.publish(frame(spark, [(None, 3, "b")])) == []
    assert all(files(snapshot.path)[p] == t for p, t in before.items())
    assert sorted(r.version for r in snapshot.rows().filter("id IS NULL").collect()) == [1, 2, 3]


def test_lost_while_put_in_place(spark, snapshot, monkeypatch):
    """The merged buckets are written aside; a job that ends there is taken up by the next."""
    updates = frame(spark, [("k3", 2, "new"), (None, 4, "n")])
    with monkeypatch.context() as m:
        m.setattr(Snapshot, "recover", lambda self: False)
        snapshot.publish(updates)
    assert values(snapshot)["k3"] == (1, "old")
    again = Snapshot.open(spark, snapshot.path)
    assert again.recover() and not again.recover()
    assert values(again)["k3"] == (2, "new") and again.rows().filter("id IS NULL").count() == 3


def test_nothing_published(spark, tmp_path):
    made = Snapshot.create(spark, str(tmp_path / "e"), "id", frame(spark, []).schema)
    assert made.rows().collect() == [] and made.of_key("x").collect() == []
    assert made.publish(frame(spark, [])) == [] and made.rows().columns == ["id", "version", "value"]
    with pytest.raises(ValueError):
        Snapshot.create(spark, str(tmp_path / "f"), "no such column", made.schema)


def test_one_key_with_most_updates(spark, snapshot):
    many = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "k1").otherwise(F.concat(F.lit("n"), "id")).alias("id"),
        F.col("id").alias("version"),
        F.lit("m").alias("value"),
    )
    snapshot.publish(many, ["version"])
    got = values(snapshot)
    assert got["k1"] == (19_998, "m") and len(got) == 400 + 13_333
