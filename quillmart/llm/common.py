"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.durable import durable

__all__ = ["crc32_sql", "durable", "free_names", "held_out", "label_sample", "rank_in_groups", "read", "source_key"]

#: Python's and the contract's white space: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id is held out, it is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor == remainder, F.lit(True))


def source_key(source: Column) -> Column:
    """A non-null grouping key in which a null source is a group of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def label_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, divisor: int, remainder: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, y) of the part that is not held out.

    The sample is the labels with the smallest hash of the id, taken before any text is touched, so at most ``rows``
    ids are broadcast and texts are never shuffled for it. Several labels of one id count as their maximum; labels
    other than 0 and 1 and null ids are ignored.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), divisor, remainder))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit(17), "_id"), "_id")
        .limit(rows)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def rank_in_groups(rows: DataFrame, group: str, order: list[Column], seed: int, buckets: int = 2048) -> DataFrame:
    """Add ``rank`` (from 0) and ``group_rows`` to every row: its place in a seeded shuffle of its group.

    A group is dealt over ``buckets`` hash buckets. Row counts of the buckets are summed before they move, the sums
    in front of a bucket are its offset, and rows are numbered inside one bucket only, so a group that holds a third
    of all rows is spread like any other. All of ``order`` seeds the shuffle, so rows with one id, or none, are spread
    as well where anything else tells them apart.
    """
    shuffled = F.xxhash64(F.lit(seed), *order)
    keyed = rows.withColumn("_h", shuffled).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(group)).alias("group_rows"))
    inside = Window.partitionBy(group, "_b").orderBy("_h", *order)
    numbered = keyed.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [group, "_b"]).withColumn("rank", F.col("_o") + F.col("_i")).drop("_h", "_b", "_o", "_i")


def free_names(rows: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores in front until the rows have no such column in any case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def crc32_sql(text: str) -> str:
    """DuckDB expression of the CRC-32 of an ASCII text, of which DuckDB has no function; null for null."""
    bit = "lambda c, _: xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), {byte}), 4294967295)"
