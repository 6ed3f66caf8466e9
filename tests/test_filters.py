"""Predicates on rows with nulls and sentinels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.operators import filters as P
from quillmart.sources.files import preferred_first


def ids(df):
    return sorted(r.i for r in df.collect())


def test_predicates(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "merged", True, 0.9), (3, "active", False, 0.9), (4, "review", None, 0.4)], "i int, status string, flag boolean, sure double")
    assert ids(df.where(P.status_not_in(F.col("status"), ["merged", "review"]))) == [1, 3]
    assert ids(P.one_of(df, "status", ["", "all", None])) == [1, 2, 3, 4] and ids(P.one_of(df, "status", ["all", "merged"])) == [2]
    assert ids(df.where(P.confident(F.col("flag"), F.col("sure"), 0.4))) == [3, 4]


def test_months(spark):
    df = spark.createDataFrame([(1, "2024-03"), (2, "2023-03"), (3, "2024-12"), (4, None), (5, "2024-3")], "i int, ym string")
    assert ids(df.where(P.in_months(F.col("ym"), [2024], [3]))) == [1, 5] and ids(df.where(P.in_months(F.col("ym"), months=[3]))) == [1, 2, 5]
    assert [r[0] for r in df.select(P.masked_month(F.col("ym"), 2024, 2025)).collect()] == ["2024-03", "", "2024-12", "", ""]


def test_mentioning_reads_both_sides(spark):
    df, found = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (None, "x")], "i int, t string"), spark.createDataFrame([(3,), (3,), (None,)], "k int")
    got = P.mentioning(df, "i", F.col("t") == "x", found)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x"), (3, None), (None, "x")], key=repr) and got.columns == ["i", "t"]


def test_preferred_columns_come_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert preferred_first(df, ["c", "missing"]).columns == ["c", "a", "b"]


def test_every_dictionary_mention_has_its_place(spark):
    """Words inside others are mentions too, places count characters, and the longest word of an owner is its best."""
    from quillmart.operators.rules import best_mentions, dictionary_mentions

    texts = ["É Apache License, apache", "smith mitx", None, "MIT license mit a b a b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dictionary_mentions(docs, "doc_id", "text", ["apache", "apache license", "mit", "mit license", "a b a"])
    assert sorted(map(tuple, found.collect())) == [(0, "apache", 2), (0, "apache", 18), (0, "apache license", 2), (3, "a b a", 16), (3, "a b a", 20), (3, "mit", 0), (3, "mit", 12), (3, "mit license", 0)]
    best = best_mentions(found, "doc_id", {"apache": "apache", "apache license": "apache", "mit": "mit", "mit license": "mit"})
    assert sorted(map(tuple, best.collect())) == [(0, "apache", "apache license", 2), (3, "mit", "mit license", 0)]
