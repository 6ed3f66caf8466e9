"""The generic pivot: keys by rows and columns, named metrics, long form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """kind is count_distinct, count, sum, max or avg; ``where`` filters the rows of this metric alone."""

    name: str
    kind: str
    column: str
    where: Column | None = None


@dataclass(frozen=True)
class PivotSpec:
    rows: list[str]
    metrics: list[Metric]
    columns: list[str] = field(default_factory=list)


_KINDS = {
    "count_distinct": F.count_distinct,
    "count": F.count,
    "sum": lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)),
    "max": F.max,
    "avg": F.avg,
}


def _metric(df: DataFrame, m: Metric) -> Column:
    if m.kind not in _KINDS:
        raise ValueError(f"unknown aggregate {m.kind}")
    if m.column not in df.columns:
        return F.lit(0).alias(m.name)
    value = F.col(m.column) if m.where is None else F.when(m.where, F.col(m.column))
    return _KINDS[m.kind](value).alias(m.name)


def pivot(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """One record for each combination of keys; null keys are a group.

    Sums of nothing are 0, largest and average of nothing null, a metric over a missing column is 0. Without keys an
    empty input gives no record.
    """
    keys = [*spec.rows, *spec.columns]
    out = df.groupBy(*keys).agg(*[_metric(df, m) for m in spec.metrics], F.count(F.lit(1)).alias("_rows"))
    return out.where("_rows > 0").drop("_rows")


def repeat_groups(df: DataFrame, key: str, order: list[Column], columns: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key side by side: column_1, column_2, ..."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most)
    cells = [F.max(F.when(F.col("_n") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, most + 1) for c in columns]
    return numbered.groupBy(key).agg(*cells)
