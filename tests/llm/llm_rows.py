"""Awkward rows that every operator on documents must take, as tables."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} über {i}" for i in range(60_000))

#: doc_id, text, lang, source: nulls in any column, empty and blank texts, a very long one, ties and repeated rows.
EDGE = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "web"),
    (2, "the quick  brown fox\tjumps over the lazy dog", "en", "web"),
    (2, "the quick  brown fox\tjumps over the lazy dog", "en", "web"),
    (3, None, "en", "web"),
    (4, "", None, "wiki"),
    (5, " \t\n\x0b\x0c\r ", "de", None),
    (6, "der schnelle braune Fuchs springt über den faulen Hund", "de", None),
    (7, "12345 --- !!!", "fr", "web"),
    (None, "a row without an identifier", "en", "web"),
    (None, None, None, None),
    (8, LONG, "en", "web"),
    (9, "a b c", "es", "wiki"),
    (10, "A B C", "es", "wiki"),
    (11, "\x00 odd   blanks \U0001f600 and ﻿ marks", "en", "wiki"),
]
CLASHING = ["rank", "group_rows", "size", "shard", "slot", "sha", "norm", "part", "parts", "score", "held_out", "kept", "keep_id", "component_id", "cls", "label", "n", "_h", "_b", "_k", "stratum", "at", "cell", "y", "piece", "length", "_id", "_keep", "_place", "_slot", "_line", "_quality_score", "sentence_ids", "licenses"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def with_clashes(df):
    """The same rows with further columns, under names that operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"other {c}").alias(c) for c in CLASHING if c not in df.columns])
