"""Exact dedup by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import BLANKS, durable

#: A text is dealt in parts once it has more copies than this and more than one row in ten thousand.
LEAST_COPIES, MOST_HOT = 64, 10_000


def _grouped(documents: DataFrame, with_rows: bool) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha of every row, and its own columns as the struct ``row`` if asked for.

    Rows of a text with many copies are dealt in parts by their place in the scan, so equal rows part as well.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if with_rows else []
    base = documents.select("doc_id", F.regexp_replace(text, BLANKS + "+", "").alias("norm"), F.char_length(text).alias("points"), *row)
    base = base.withColumn("sha", F.sha2("norm", 256))
    counts = durable(base.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > LEAST_COPIES))
    total = documents.count()
    part_rows = max(LEAST_COPIES, -(-total // MOST_HOT))
    hot = F.broadcast(counts.where(F.col("copies") > part_rows).select("sha", F.ceil(F.col("copies") / part_rows).alias("parts")))

    also = ["row"] if with_rows else []
    dealt = base.join(hot, "sha", "left").select(
        "doc_id", "norm", "points", "sha", *also,
        F.substring("norm", 1, 32).alias("head"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.when(F.col("parts") > 1, F.pmod(F.monotonically_increasing_id(), F.col("parts"))).otherwise(0).alias("part"),
    )
    best = [F.desc("points"), F.asc_nulls_last("doc_id")]
    near = Window.partitionBy("head", "sha", "part").orderBy("norm", *best)
    ordered = dealt.repartitionByRange("head", "sha", "part")
    ordered = ordered.withColumn("starts", F.coalesce(F.col("norm") != F.lag("norm").over(near), F.lit(True)))
    ordered = ordered.select(
        "doc_id", "points", "head", "sha", "part", "parts", "starts",
        F.sum(F.col("starts").cast("int")).over(near).alias("run"),
        F.when(F.col("starts") & (F.col("parts") > 1), F.col("norm")).alias("norm"),
        *[F.when(F.col("starts"), F.col(c)).alias(c) for c in also],
    )
    same = Window.partitionBy("head", "sha", "part", "run")
    grouped = durable(
        ordered.select(
            "doc_id", "points", "head", "sha", "part", "parts", "run", "starts", "norm", *also,
            F.count(F.lit(1)).over(same).alias("size"),
            F.first("doc_id").over(same.orderBy(*best)).alias("keep"),
        ).where("starts" if with_rows else "true")
    )

    # First rows of the parts of hot texts: at most 2 * MOST_HOT, unless digests collide.
    meet = Window.partitionBy("sha").orderBy("norm", *best)
    firsts = grouped.where("starts and parts > 1").withColumn("new", F.coalesce(F.col("norm") != F.lag("norm").over(meet), F.lit(True)))
    firsts = firsts.withColumn("whole", F.sum(F.col("new").cast("int")).over(meet))
    whole = Window.partitionBy("sha", "whole")
    merged = firsts.select(
        "sha", "part", "run",
        F.sum("size").over(whole).alias("all_size"),
        F.first("doc_id").over(whole.orderBy(*best)).alias("all_keep"),
        (F.row_number().over(whole.orderBy(*best, "part")) == 1).alias("wins"),
    )
    out = grouped.join(F.broadcast(merged), ["sha", "part", "run"], "left")
    alone = F.col("all_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("keep")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("starts") & F.coalesce("wins", F.lit(True))).alias("kept"),
        "sha",
        *also,
    )


def exact_dedup(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are range-partitioned by sampled splitters over (first 32 characters of the normalised text, digest) and
    sorted externally by that and the whole normalised text, so equal texts end up adjacent; each row is compared in
    full with its neighbour, and a new group starts where they differ. The digest keeps the splitters short, whatever
    the texts' lengths; it never decides that two texts are equal. Of a group the row with the most code points, then
    the smallest doc_id, stays.

    A text with many copies is dealt in parts of bounded size. Its parts are sorted and compared like any others and
    only their first rows meet again. There are at most ``MOST_HOT`` such texts, since each holds more than one row in
    ``MOST_HOT``; so their digests and the results of their parts are small enough to broadcast at any input size.

    Null counts as empty; empty texts are one group. Rows with a null doc_id sort last and stay only where no other
    row of the group has an id. Of rows that repeat an id with equal texts one stays. An empty table gives no rows;
    other columns are ignored.
    """
    return _grouped(documents, False).withColumnRenamed("sha", "text_sha256")


def drop_copies(documents: DataFrame) -> DataFrame:
    """The row that stays of each group of equal texts, with its own columns; whole rows move once, with their text.

    Nulls, empty texts and repeated rows are judged as in exact_dedup: every group, that of the empty texts included,
    keeps exactly one row.
    """
    return _grouped(documents, True).where("kept").select("row.*")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256 FROM g
"""
