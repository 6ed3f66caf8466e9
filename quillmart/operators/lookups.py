"""Lookups by several keys, in tiers or as alternatives, and plans that are checked before they take effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered(rows: DataFrame, tiers: list[tuple[str, DataFrame]], found: str, basis: str) -> DataFrame:
    """Add the match of the first tier that has one, and the name of that tier (``none`` without a match).

    Each tier is (name, table); a table has one row per key, and the columns it shares with the rows are the key.
    """
    out = rows
    for name, table in tiers:
        keys = [c for c in table.columns if c != found]
        out = out.join(table.withColumnRenamed(found, f"_{name}"), keys, "left")
    hits = [F.col(f"_{name}") for name, _ in tiers]
    label = reduce(lambda c, t: c.when(F.col(f"_{t[0]}").isNotNull(), t[0]), tiers[1:], F.when(hits[0].isNotNull(), tiers[0][0]))
    return out.withColumn(found, F.coalesce(*hits)).withColumn(basis, label.otherwise("none")).select(*rows.columns, found, basis)


def either_key(left: DataFrame, right: DataFrame, key: str, others: list[str]) -> DataFrame:
    """Inner join where the left key equals any of several right columns: one equi-join each, every pair once."""
    joins = [left.join(right, F.col(key) == F.col(c)) for c in others]
    return reduce(lambda a, b: a.union(b), joins).distinct()


def capped_texts(texts: Column, budget: int) -> Column:
    """The texts of an array in order, without those that would take the total length beyond the budget."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda a, x: a["used"] + F.char_length(x) <= budget
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + F.char_length(x)).alias("used"), F.array_append(a["kept"], x).alias("kept"))).otherwise(a)
    return F.aggregate(texts, start, step, lambda a: a["kept"])


def shortened(c: Column, most: int = 210, least: int = 80) -> Column:
    """Text of at most ``most`` characters: cut after its last full stop from ``least`` on, else cut hard."""
    head = F.substring(c, 1, most)
    stop = most + 1 - F.instr(F.reverse(head), ".")
    return F.when(F.char_length(c) <= most, c).when((F.instr(head, ".") > 0) & (stop >= least), F.substring(c, F.lit(1), stop)).otherwise(head)
