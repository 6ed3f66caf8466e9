"""Choosing rows: latest, best, numbered, budgeted, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each group in the given order (the latest, the best scored, the representative)."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") <= most).drop("_n")


def chunked(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("chunk", F.floor(place / size).cast("int"))


def merged_on_key(old: DataFrame, new: DataFrame, key: str, latest: list[str], largest: list[str], count: str) -> DataFrame:
    """Upsert: new values over old where filled, the larger of some, counts added; both sides unique by key."""
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in [*latest, *largest, count]])
    both = old.join(n, F.col(key) == F.col("_key"), "full_outer")
    return both.select(
        F.coalesce(key, "_key").alias(key),
        *[F.coalesce(f"_{c}", c).alias(c) for c in latest],
        *[F.greatest(c, f"_{c}").alias(c) for c in largest],
        (F.coalesce(F.col(count), F.lit(0)) + F.coalesce(F.col(f"_{count}"), F.lit(0))).alias(count),
    )


def repointed(child: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Children of merged entities moved to their canonical one; mapping is (duplicate_id, canonical_id)."""
    moved = child.join(mapping, child[key] == mapping["duplicate_id"], "left")
    return moved.withColumn(key, F.coalesce("canonical_id", key)).drop("duplicate_id", "canonical_id")
