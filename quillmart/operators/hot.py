"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions.durable import durable

#: A key is hot with more rows than this and more than one row in ten thousand, so there are at most MOST_HOT.
LEAST_ROWS, MOST_HOT = 64, 10_000


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> DataFrame | None:
    """(key, rows_of_key) of the hot keys, at most MOST_HOT, written once; None if there are none.

    They are counted with partial sums, so a hot key is no task of its own.
    """
    total = rows.count() if total is None else total
    most = max(LEAST_ROWS, -(-total // MOST_HOT))
    if total <= most:
        return None
    hot = durable(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") > most))
    return None if hot.isEmpty() else hot


def join_unique(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Rows joined with a table that is unique by ``key`` (not null); ``how`` is inner or left.

    The table's rows of hot keys are broadcast (at most MOST_HOT), so rows of a hot key stay where they are; only
    the others are shuffled by key.
    """
    if hot is None:
        return rows.join(table, key, how)
    keys = F.broadcast(hot.select(key))
    hot_rows = rows.join(keys, key, "left_semi").join(F.broadcast(table.join(keys, key, "left_semi")), key, how)
    return hot_rows.unionByName(rows.join(keys, key, "left_anti").join(table, key, how))
