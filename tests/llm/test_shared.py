from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from inkgraph.llm import shared


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_joins_as_usual(spark, monkeypatch, how):
    monkeypatch.setattr(shared, "HOT", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaabbbcdde")] + [(None, 99)], "k string, i int")
    table = spark.createDataFrame([("a", "A", 5), ("b", "B", 3), ("c", "C", 1), ("z", "Z", 0)], "k string, v string, n long")
    want = rows.join(table.drop("n"), "k", how).select("k", "i", "v").collect()
    found = shared.join_hot(rows, table, "k", how).select("k", "i", "v").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, want), key=repr)


def test_scratch_is_resolved_and_deleted(spark):
    assert shared._qualified(spark, "/some/folder") == "file:///some/folder"
    assert shared._qualified(spark, "file:/some/folder") == "file:///some/folder"
    with shared.only(spark) as keep:
        gone, kept = (shared.materialize(spark.range(3), name) for name in ("gone", "kept"))
        keep(kept)
    exists = lambda df: os.path.exists(df._scratch_path.removeprefix("file://"))
    assert not exists(gone) and exists(kept) and kept.count() == 3
    shared.discard(kept)
    assert not exists(kept)


def test_names_that_are_taken(spark):
    frame = spark.createDataFrame([(1, 2)], "_x int, _X_ int")
    assert shared.fresh(frame, "_x") == "_x__" and shared.fresh(frame, "_y") == "_y"


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        shared.bound_batches(spark)
        assert spark.conf.get(name).rstrip("b") == str(shared.BATCH_BYTES)
        spark.conf.set(name, "1000")
        shared.bound_batches(spark)
        assert spark.conf.get(name).rstrip("b") == "1000"
    finally:
        spark.conf.set(name, own)


@pytest.mark.parametrize("words", [1 << 22, 2])
def test_bitmap_of_keys(spark, monkeypatch, words):
    """Has every key, whatever its size, and few others while it may grow."""
    monkeypatch.setattr(shared, "KEY_WORDS", words)
    keys = spark.range(3000).select((F.xxhash64("id") if words > 2 else F.col("id") - 1500).alias("k"))
    rows = keys.union(spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id")))
    left = rows.where(shared.maybe_among(F.col("k"), keys))
    assert left.join(keys, "k").count() == 3000
    assert words == 2 or left.count() < 3200
    assert rows.where(shared.maybe_among(F.col("k"), keys.limit(0))).count() == 0
