"""Lookup and text operators on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.operators import lookups as L


def test_tiers_take_the_first_match(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "b")], "i int, k string")
    first, second = spark.createDataFrame([(1, 10)], "i int, hit int"), spark.createDataFrame([("a", 20), ("b", 30)], "k string, hit int")
    got = L.tiered(rows, [("id", first), ("key", second)], "hit", "basis")
    assert sorted(map(tuple, got.select("k", "hit", "basis").collect()), key=repr) == sorted([("a", 10, "id"), ("b", 30, "key"), (None, None, "none"), ("b", 30, "key")], key=repr)


def test_either_key_gives_each_pair_once(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 1), (2, 1), (3, None)], "a int, b int")
    assert sorted(map(tuple, L.either_key(left, right, "k", ["a", "b"]).collect())) == [(1, 1, 1), (1, 2, 1), (2, 2, 1)]


def test_budget_passes_over_long_texts(spark):
    df = spark.createDataFrame([(["abc", "toolong", "de", "f", "g"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(L.capped_texts(F.col("l"), 6)).collect()] == [["abc", "de", "f"], [], None]


def test_shortened_ends_at_a_late_full_stop(spark):
    df = spark.createDataFrame([("short.",), ("a" * 90 + ". " + "b" * 200,), ("a." + "b" * 300,), ("c" * 300,), (None,)], "t string")
    assert [r[0] for r in df.select(L.shortened(F.col("t"))).collect()] == ["short.", "a" * 90 + ".", ("a." + "b" * 300)[:210], "c" * 210, None]
