"""Text, number and month functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_key(c: Column) -> Column:
    """Lower case without blanks and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "[ \t\r\n]+", " "))


def compacted(c: Column, drop: str = " -/") -> Column:
    """Lower case without the given characters; null is empty."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), drop, "")


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def versions(c: Column) -> Column:
    """Distinct version marks such as v2 or 2.0, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(v[0-9]+|[0-9]+\.[0-9]+)"), 1))


def input_hash(c: Column) -> Column:
    """SHA-256 of the trimmed lines that are not blank."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.sha2(F.array_join(lines, "\n"), 256)


def article_hash(url: Column, title: Column, body: Column) -> Column:
    return F.sha2(F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))), 256)


def rough_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(c) * 2 / 5)).cast("long")


def sentences(c: Column, ends: str = "[.!?]+[ \n]+|\n+") -> Column:
    return F.filter(F.transform(F.split(c, ends), lambda x: F.trim(x)), lambda x: x != "")


def strip_prefixes(c: Column, prefixes: list[str], most: int = 3) -> Column:
    return F.regexp_replace(c, f"^(?:(?:{'|'.join(prefixes)})[ ,]+){{1,{most}}}", "")


# Factors of the magnitude words that follow a number.
MAGNITUDES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}


def amount(c: Column) -> Column:
    """The first number, times its magnitude word, cut to a whole number; null without a number."""
    number = F.regexp_extract(F.lower(c), r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    word = F.regexp_extract(F.lower(c), r"[0-9][0-9,.]*\s*(thousand|million|billion)", 1)
    factor = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in MAGNITUDES.items()], F.lit(1))
    return F.floor(F.expr("1") * F.regexp_replace(number, ",", "").try_cast("decimal(20,4)") * factor).cast("long")


def year_month(c: Column, published: Column) -> Column:
    """yyyy-MM out of text: a written month, or last/this month relative to the date of publication."""
    year, month = F.regexp_extract(c, r"(20[0-9]{2})[-./ ]?(0[1-9]|1[0-2])", 1), F.regexp_extract(c, r"(20[0-9]{2})[-./ ]?(0[1-9]|1[0-2])", 2)
    return (
        F.when(year != "", F.concat(year, F.lit("-"), month))
        .when(F.lower(c).contains("last month"), F.date_format(F.add_months(F.to_date(published), -1), "yyyy-MM"))
        .when(F.lower(c).contains("this month"), F.date_format(published, "yyyy-MM"))
    )


def months(ym: Column) -> Column:
    """Months since year 0 of yyyy-MM; null if malformed."""
    return F.when(ym.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.substring(ym, 1, 4).cast("int") * 12 + F.substring(ym, 6, 2).cast("int"))


def tokens(c: Column, stop: list[str], least: int = 2) -> Column:
    """Distinct lower-case letter runs that carry information."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1))
    return F.filter(found, lambda x: (F.char_length(x) >= least) & ~x.isin(*stop))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller set; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))
