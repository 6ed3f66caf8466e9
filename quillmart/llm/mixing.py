"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import free_names, rank_in_groups, source_key

#: Slots of one period of the schedule; target weights are whole parts of it.
PERIOD, MOST_SOURCES = 4096, 100_000


def parts_of(shares: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole parts of the period that come nearest to the shares by largest remainder, at least one each."""
    period = max(period, 1 << (8 * len(shares)).bit_length())
    total = sum(shares.values())
    free = period - len(shares)
    exact = {k: v / total * free for k, v in shares.items()}
    parts = {k: 1 + int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[: period - sum(parts.values())]:
        parts[k] += 1
    return parts


def pfair_period(parts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block of the period, slot, release, deadline) of one period of sum(parts) slots.

    Block j of a source with a of M parts may start at slot floor(j * M / a) and must end by ceil((j + 1) * M / a).
    At every slot the released block with the earliest deadline runs. Windows of this kind are always met on one
    line of slots, so after any number of slots each source is less than one block off its target.
    """
    period = sum(parts.values())
    coming = [(0, k, 0) for k in sorted(parts)]
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            release, k, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[k]), k, j, release))
        deadline, k, j, release = heapq.heappop(ready)
        out.append((k, j, slot, release, deadline))
        if j + 1 < parts[k]:
            heapq.heappush(coming, ((j + 1) * period // parts[k], k, j + 1))
    return out


def source_rows(documents: DataFrame) -> dict[str, int]:
    """Rows by source key: one row per source reaches the driver, more than MOST_SOURCES is an error."""
    rows = documents.groupBy(source_key(F.col("source")).alias("k")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; give target weights for groups of them")
    return {r["k"]: r["n"] for r in rows}


def bound_ends(parts: dict[str, int], plan: list[tuple[str, int, int, int, int]], rows: dict[str, int], block_rows: int) -> int:
    """The last slot up to which every source still has blocks; -1 if one has no row at all."""
    at = {(k, j): slot for k, j, slot, _, _ in plan}
    period, ends = sum(parts.values()), []
    for k, a in parts.items():
        turn, j = divmod(-(-rows.get(k, 0) // block_rows) - 1, a)
        ends.append(at[k, j] + turn * period)
    return max(-1, min(ends, default=-1))


def mix_sources(documents: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 16, seed: int = 23, exponent: float = 0.7) -> DataFrame:
    """The place of every row: doc_id, _k (source key), _crc, _block, _slot, _release, _deadline, _within, _weight, _bounded.

    Rows of a source are shuffled by a seeded hash and cut in blocks. The schedule of one period is worked out once
    from the weights alone (its size does not depend on the rows) and repeats, so the slot of any block is plain
    arithmetic. In the order (_slot, _within) every source is less than a block off its target weight for as long as
    all sources last, which ``_bounded`` says; a source that is over-represented goes on, in the same slots, after the others have run out,
    so no row is lost. Weights left out are the sources' row counts to the power ``exponent``, which lifts small
    sources; given weights need not sum to one, and rows of sources that have none (or zero) are not in the mix.

    A null source is a source (key None in ``weights``); rows with equal ids are told apart by their text's checksum,
    equal rows take neighbouring places in either order. Null and empty texts are mixed like others. An empty table
    gives no rows. Columns other than doc_id, text and source are ignored.
    """
    counted = source_rows(documents)
    if weights is None:
        shares = {k: float(n) ** exponent for k, n in counted.items()}
    else:
        shares = {"-" if k is None else f"={k}": float(v) for k, v in weights.items() if v > 0}
    spark = documents.sparkSession
    parts = parts_of(shares) if shares else {}
    windows = pfair_period(parts)
    last = bound_ends(parts, windows, counted, block_rows)
    plan = spark.createDataFrame([(k, parts[k], *rest) for k, *rest in windows], "_k string, _parts int, _j int, _at long, _from long, _by long")
    period = sum(parts.values())

    keys = documents.select("doc_id", source_key(F.col("source")).alias("_k"), F.crc32(F.coalesce("text", F.lit(""))).alias("_crc"))
    ranked = rank_in_groups(keys, "_k", [F.col("doc_id"), F.col("_crc")], seed)
    ranked = ranked.withColumn("_block", F.floor(F.col("rank") / block_rows)).withColumn("_within", (F.col("rank") % block_rows).cast("int"))
    sizes = spark.createDataFrame(list(parts.items()), "_k string, _a int")
    slotted = ranked.join(F.broadcast(sizes), "_k").withColumn("_j", (F.col("_block") % F.col("_a")).cast("int")).withColumn("_turn", F.floor(F.col("_block") / F.col("_a")))
    slotted = slotted.join(F.broadcast(plan), ["_k", "_j"])
    later = F.col("_turn") * period
    slot = F.col("_at") + later
    return slotted.select("doc_id", "_k", "_crc", "_block", slot.alias("_slot"), (F.col("_from") + later).alias("_release"), (F.col("_by") + later).alias("_deadline"), "_within", F.col("_parts").alias("_weight"), (slot <= last).alias("_bounded"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents' own columns in the order of the mix: range-partitioned and sorted by slot.

    Files written from it hold consecutive runs of the schedule, so a reader that goes through a file sees sources at
    their target weights; a stage after this one that works file by file, such as packing, keeps to the order.
    """
    names = documents.columns
    places = mix_sources(documents, **options)
    id_, key, crc, place = free_names(documents, "_mix_id", "_mix_key", "_mix_crc", "_mix_place")
    first = places.groupBy(F.col("doc_id").alias(id_), F.col("_k").alias(key), F.col("_crc").alias(crc)).agg(F.min(F.struct("_slot", "_within")).alias(place))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (source_key(F.col("source")) == F.col(key)) & (F.crc32(F.coalesce("text", F.lit(""))) == F.col(crc))
    return documents.join(first, same).repartitionByRange(place, "doc_id").sortWithinPartitions(place, "doc_id").select(*names)
