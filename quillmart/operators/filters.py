"""Predicates of the query surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_not_in(c: Column, excluded: list[str], default: str = "active") -> Column:
    return ~F.coalesce(c, F.lit(default)).isin(*excluded)


def one_of(df: DataFrame, column: str, values: list, sentinels: tuple = ("", "all")) -> DataFrame:
    """An IN filter; empty values and sentinels are ignored, and without values nothing is filtered."""
    wanted = [v for v in values or [] if v is not None and v not in sentinels]
    return df.where(F.col(column).isin(*wanted)) if wanted else df


def included(flag: Column, role: Column, status: Column, extra_roles: list[str], excluded_roles: list[str], excluded_statuses: list[str]) -> Column:
    """The flag or an extra role lets in; excluded roles and statuses keep out."""
    return ((flag == "Y") | role.isin(*extra_roles)) & ~role.isin(*excluded_roles) & status_not_in(status, excluded_statuses)


def confident(needs_review: Column, confidence: Column, least: float) -> Column:
    return ~F.coalesce(needs_review, F.lit(False)) & (F.coalesce(confidence, F.lit(0.0)) >= least)


def in_months(ym: Column, years: list[int] | None = None, months: list[int] | None = None) -> Column:
    """Any of the years, any of the months, or both crossed."""
    ok = F.lit(True)
    if years:
        ok = ok & F.substring(ym, 1, 4).cast("int").isin(*years)
    if months:
        ok = ok & F.substring(ym, 6, 2).cast("int").isin(*months)
    return ok


def masked_month(ym: Column, first: int, last: int) -> Column:
    """The month if well formed and in the visible years, else empty."""
    visible = ym.rlike("^[0-9]{4}-[0-9]{2}$") & F.substring(ym, 1, 4).cast("int").between(first, last)
    return F.when(visible, ym).otherwise("")


def mentioning(base: DataFrame, key: str, own: Column, found: DataFrame) -> DataFrame:
    """Rows of the base that hold the text themselves or whose key is among ``found`` (one column); the base is read once."""
    keys = found.select(F.col(found.columns[0]).alias("_key")).distinct()
    return base.join(keys, F.col(key) == F.col("_key"), "left").where(F.coalesce(own, F.lit(False)) | F.col("_key").isNotNull()).drop("_key")


def folded_equal(c: Column, wanted: str, default: str) -> Column:
    """Equality without regard to case and outer blanks; null is the default."""
    return F.lower(F.trim(F.coalesce(c, F.lit(default)))) == wanted


def no_suffix(columns: list[Column], suffixes: list[str]) -> Column:
    """None of the columns, trimmed, ends with any of the suffixes; null ends with nothing."""
    ends = F.lit(False)
    for c in columns:
        for s in suffixes:
            ends = ends | F.endswith(F.trim(F.coalesce(c, F.lit(""))), F.lit(s))
    return ~ends


def holds_word(c: Column, word: str) -> Column:
    """The word in the lower-case text, or both without blanks, hyphens and slashes."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.contains(low, F.lit(word)) | F.contains(F.translate(low, " -/", ""), F.lit(word.translate({ord(x): None for x in " -/"})))
