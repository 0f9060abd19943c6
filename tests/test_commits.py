"""The keyed table: snapshots, lost races, crashes between writes, merging of batches, many keys."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import feed
from tallyforge.operators.commits import Conflict, KeyedTable

SCHEMA = "k string, v int"


def shown(snapshot, only=None):
    rows = snapshot.rows(only)
    return [] if rows is None else sorted((r["k"], r["v"]) for r in rows.collect())


def test_upsert_delete_and_time_travel(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", 4)
    assert shown(t.snapshot()) == [] and t.snapshot().keys() is None
    one = t.upsert(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], SCHEMA))
    two = t.upsert(spark.createDataFrame([("a", 4)], SCHEMA), spark.createDataFrame([("b",), ("nobody",), (None,)], "k string"))
    assert (one, two) == (1, 2)
    assert shown(t.snapshot(1)) == [("a", 1), ("a", 2), ("b", 3)] and shown(t.snapshot()) == [("a", 4)]
    wide = t.upsert(spark.createDataFrame([("c", 5, "x", 9)], "k string, v int, more string, __bucket int"))
    assert shown(t.snapshot()) == [("a", 4), ("c", 5)] and shown(t.snapshot(), spark.createDataFrame([("c",), ("b",)], "k string")) == [("c", 5)]
    assert {(r["k"], r["more"]) for r in t.snapshot(wide).rows().collect()} == {("a", None), ("c", "x")}
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == 4 and shown(t.snapshot()) == [("a", 4), ("c", 5)]
    with pytest.raises(Exception, match="k is null"):
        t.upsert(spark.createDataFrame([(None, 1)], SCHEMA))
    assert t.versions() == [1, 2, 3, 4]


def test_merged_batches_hold_the_same_rows(spark, tmp_path):
    t, held = KeyedTable(spark, str(tmp_path), "k", 4), {}
    for i in range(9):
        batch = [(f"k{(3 * i + j) % 11}", 100 * i + j) for j in range(4)]
        gone = f"k{(7 * i) % 11}"
        t.upsert(spark.createDataFrame(batch, SCHEMA), spark.createDataFrame([(gone,)], "k string"))
        for k in {gone, *(k for k, _ in batch)}:
            held[k] = sorted(v for own, v in batch if own == k)
        t.compact()
        assert shown(t.snapshot()) == sorted((k, v) for k, own in held.items() for v in own)
    assert len(t.snapshot().batches) <= 5  # a geometric family, not a batch per commit
    t.compact(whole=True)
    assert len(t.snapshot().batches) == 1 and shown(t.snapshot()) == sorted((k, v) for k, own in held.items() for v in own)
    old = len(os.listdir(tmp_path / "data"))
    assert t.vacuum(older_ms=10**12) == 0 and len(os.listdir(tmp_path / "data")) == old
    assert t.vacuum(older_ms=0) > 0 and len(os.listdir(tmp_path / "data")) == 1 and len(t.versions()) == 1
    assert shown(t.snapshot()) == sorted((k, v) for k, own in held.items() for v in own)


def test_races(spark, tmp_path):
    t, other = (KeyedTable(spark, str(tmp_path), "k", 4) for _ in range(2))
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], SCHEMA))
    tries = []

    def doubled(now):
        tries.append(now.version)
        if len(tries) == 1:  # another writer is first
            other.upsert(spark.createDataFrame([("a", 10)], SCHEMA))
        return now.rows().withColumn("v", F.col("v") * 2), None

    t.rewrite(doubled)
    assert tries == [1, 2] and shown(t.snapshot()) == [("a", 20), ("b", 2)]  # nobody's change is lost

    def late(now):
        other.upsert(spark.createDataFrame([("z", now.version)], SCHEMA))
        return now.rows(), None

    with pytest.raises(Conflict):
        t.rewrite(late, tries=2)
    assert not t._put(t.versions()[-1], "{}") and not [f for f in os.listdir(tmp_path / "log") if not f.startswith("0") and not f.endswith(".crc")]
    # a batch that is committed while others are merged stays above the merged one
    commit = t._commit

    def interrupted(made):
        t._commit = commit
        other.upsert(spark.createDataFrame([("a", 7)], SCHEMA))
        return commit(made)

    t._commit = interrupted
    t.compact(whole=True)
    assert len(t.snapshot().batches) == 2 and ("a", 7) in shown(t.snapshot()) and ("a", 20) not in shown(t.snapshot())


def test_a_crash_between_the_writes_leaves_the_old_feed(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path / "feed"), "feed_key string, run_id string, gate_result string"
    feed.publish(spark, spark.createDataFrame([("a", "1", "accepted"), ("b", "1", None)], schema), folder)
    batch = spark.createDataFrame([("a", "2", "withheld:failed")], schema)
    seen = lambda: {n: [(r["feed_key"], r["run_id"]) for r in feed.read(spark, folder, n).collect()] for n in feed.SIDES}
    before = seen()

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(KeyedTable, "_put", dies)
        feed.publish(spark, batch, folder)
    assert seen() == before == {"transactions": [("a", "1")], "review": [("b", "1")]}
    feed.publish(spark, batch, folder)
    assert seen()["transactions"] == [] and sorted(seen()["review"]) == [("a", "2"), ("b", "1")]


def test_many_keys_make_few_files(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k")
    t.upsert(spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("int").alias("v")))
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 16 and t.snapshot().rows().count() == 50_000
    assert t.snapshot().rows(spark.createDataFrame([("hot",)], "k string")).count() == 16_667
