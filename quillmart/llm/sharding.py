"""Sharding by proportional stratified interleaving, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import rank_in_groups, source_key

#: Cells of the fractional-rank axis; their counts are the only thing that one task sums.
CELLS = 4096


def stratified_shards(documents: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; law is ``rows``.

    Rows of a source are shuffled by a seeded hash and ranked; (rank + phase) / rows of the source is a fractional
    rank, where the source's phase in [0, 1) keeps tiny sources from piling up at one place. Sorted by it, every
    source is spread evenly, and cutting the order in equal runs gives shards whose sizes differ by at most one row
    and whose mixture is that of the whole, to one row of each source at either end. Only ids, sizes and checksums
    are shuffled, never texts.

    A null or empty text has size 16 and checksum 0; a null source is a stratum of its own; rows that are equal in
    id, size and checksum take neighbouring ranks in either order, which is the same result. Equal texts are not kept
    together: under this law a group of copies may be larger than a shard. An empty table gives no rows; columns
    other than doc_id, text and source are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select("doc_id", source_key(F.col("source")).alias("stratum"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ranked = rank_in_groups(base, "stratum", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], seed)
    phase = F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1 << 20)) / float(1 << 20)
    placed = ranked.withColumn("at", (F.col("rank") + phase) / F.col("group_rows"))
    placed = placed.withColumn("cell", F.least(F.floor(F.col("at") * CELLS), F.lit(CELLS - 1)).cast("int"))

    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # at most CELLS rows
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(everything).alias("total"))
    inside = Window.partitionBy("cell").orderBy("at", "stratum", "rank")
    out = placed.withColumn("i", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "cell")
    out = out.withColumn("position", F.col("first") + F.col("i"))
    out = out.withColumn("shard", F.expr(f"cast(position * {shards} div total as int)"))
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
