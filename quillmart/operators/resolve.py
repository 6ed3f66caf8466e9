"""Entity resolution: neighbours within blocks, compatibility, ordered verdicts, plans over groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.operators.hot import hot_keys


#: Rows of a block from which on its pairs are dealt over a grid of cells.
CELL_ROWS = 2048


def block_pairs(df: DataFrame, block: list[str], key: str, columns: list[str], alike: Sequence[str] = (), facts: Callable[[DataFrame], DataFrame] | None = None, symmetric: bool = False) -> DataFrame:
    """Every pair of rows of a block, the smaller key on the left; columns come twice, as left_* and right_*.

    All pairs are the result, so rows grow with the square of a block; choose a selective block. A large block is
    split, not cut: its rows are dealt over a square grid, and each cell meets one part of them with another.

    Rows that are equal in ``alike`` are one group of a cell and move as one row. ``facts`` adds columns that depend on
    left_* and right_* of ``alike`` alone; they are worked out once for two groups, then the groups are taken apart
    where they are. If neither facts nor later columns tell left from right, ``symmetric`` takes two groups once, in
    the order of ``alike``: only the keys are then sure to be on their sides.
    """
    rows = df.select(F.xxhash64(*block).alias("_block"), *block, key, *columns, *alike)
    hot = hot_keys(rows, "_block")
    side = F.lit(1)
    if hot is not None:
        rows = rows.join(F.broadcast(hot), "_block", "left")
        side = F.ceil(F.coalesce("rows_of_key", F.lit(1)) / CELL_ROWS).cast("int")
    own, every = F.pmod(F.xxhash64(F.lit(7), key), side).cast("int"), F.explode(F.sequence(F.lit(0), side - 1))
    place = [*block, "_row", "_column"]
    # a number of tasks that stays: few bytes make many pairs
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def part(name: str, cell: str, other: str) -> DataFrame:
        dealt = rows.select(*block, own.alias(cell), every.alias(other), *[F.col(c).alias(f"{name}_{c}") for c in alike], F.struct(key, *columns).alias("_one")).repartition(tasks, *place)
        return dealt.groupBy(*place, *[f"{name}_{c}" for c in alike]).agg(F.collect_list("_one").alias(f"_{name}"))

    met = part("left", "_row", "_column").join(part("right", "_column", "_row").hint("merge"), place).drop(*place)
    if symmetric and alike:
        left, right = (F.struct(*[F.col(f"{s}_{c}").alias(c) for c in alike]) for s in ("left", "right"))
        met = met.where(left <= right).withColumn("_same", left == right)
    if facts:
        met = facts(met)
    rest = [c for c in met.columns if c not in ("_left", "_right", "_same")]
    own_facts = F.struct(*[c for c in met.columns if c not in ("_left", "_right")], F.lit(0).alias("_none"))
    # Spark puts off what is certain to where it is read, which is once a pair; a task's own number keeps the facts here
    met = met.select("_left", "_right", F.when(F.spark_partition_id() >= 0, own_facts).alias("_facts"))
    met = met.select("_facts", "_right", F.explode("_left").alias("_l")).select("_facts", "_l", F.explode("_right").alias("_r"))
    a, b = F.col(f"_l.{key}"), F.col(f"_r.{key}")
    keys = [a.alias(f"left_{key}"), b.alias(f"right_{key}")]
    if symmetric and alike:
        met = met.where((a < b) | (~F.col("_facts._same") & (a != b)))
        keys = [F.least(a, b).alias(f"left_{key}"), F.greatest(a, b).alias(f"right_{key}")]
    else:
        met = met.where(a < b)
    return met.select(*keys, *[F.col(f"_facts.{c}").alias(c) for c in rest], *[F.col(f"_{s[0]}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in columns])


def compatible(a: Column, b: Column, wildcards: list[str], soft: list[tuple[str, str]]) -> Column:
    """Equal kinds, a kind that fits all, or one of the listed pairs in either order; anything else is not."""
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    return (a == b) | a.isin(*wildcards) | b.isin(*wildcards) | pair.isin(*["|".join(sorted(p)) for p in soft])


def verdict(vetoes: list[tuple[str, Column]], accepts: list[tuple[str, int, Column]], otherwise: str) -> Column:
    """struct(accepted, confidence in hundredths, reason): the first veto that holds, else the first accept rule.

    A test that is null does not hold.
    """
    as_row = lambda ok, sure, why: F.struct(F.lit(ok).alias("accepted"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    rules = [(test, as_row(False, 0, why)) for why, test in vetoes] + [(test, as_row(True, sure, why)) for why, sure, test in accepts]
    chain = F.when(*rules[0])
    for test, row in rules[1:]:
        chain = chain.when(test, row)
    return chain.otherwise(as_row(False, 0, otherwise))


def rule_table(rules: list[tuple[bool, str, str, str]], otherwise: str) -> str:
    """SQL for struct(accepted, confidence, reason) of the first of (accepted, confidence, reason, test) that holds.

    Confidence and test are SQL over the columns of the row, so a table of rules is plain data; a null test fails.
    """
    row = lambda ok, sure, why: f"named_struct('accepted', {str(ok).lower()}, 'confidence', CAST({sure} AS INT), 'reason', '{why}')"
    return "CASE " + " ".join(f"WHEN {test} THEN {row(ok, sure, why)}" for ok, sure, why, test in rules) + f" ELSE {row(False, 0, otherwise)} END"


#: More tasks than a stage has, and rules that one compiled method tests.
MOST_TASKS, RULES = 1 << 20, 14


def compiled_apart(rows: DataFrame) -> DataFrame:
    """The same rows in the same tasks, but what follows is compiled by itself.

    Spark makes one method of what a stage does with a row, and the JVM compiles none of more than 8,000 bytes: it would
    interpret every row, some thirty times slower. No task is joined with another.
    """
    return rows.coalesce(MOST_TASKS)


def judged(rows: DataFrame, rules: list[tuple[bool, str, str, str]], otherwise: str) -> DataFrame:
    """The rows with accepted, confidence and reason of the first of (accepted, confidence, reason, test) that holds.

    Only the rule's number comes from the tests, RULES of them at a time: one expression of all rules and their results
    would be too long to be compiled.
    """
    found = rows
    for at in range(0, len(rules), RULES):
        tests = [f"WHEN _rule < {at} THEN _rule"] * (at > 0) + [f"WHEN {test} THEN {i}" for i, (*_, test) in enumerate(rules[at : at + RULES], at)]
        found = compiled_apart(found).withColumn("_rule", F.expr(f"CASE {' '.join(tests)} ELSE {min(at + RULES, len(rules))} END"))
    sure = "CASE _rule " + " ".join(f"WHEN {i} THEN CAST({sure} AS INT)" for i, (_, sure, *_) in enumerate(rules) if sure != "0") + " ELSE 0 END"
    accepted = F.col("_rule").isin([i for i, (ok, *_) in enumerate(rules) if ok])
    reasons = F.array(*[F.lit(why) for _, _, why, _ in rules], F.lit(otherwise))
    return found.withColumns({"accepted": accepted, "confidence": F.expr(sure), "reason": reasons[F.col("_rule")]}).drop("_rule")


def mapped(values: Column, mapping: dict[str, str]) -> Column:
    """The array with its values mapped, those without a mapping left out, each once, in order of first sight."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()))


def stems(name: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """The name and what is left of it without a prefix, a suffix, or both, each once, the whole name first."""
    front = F.regexp_replace(name, f"^({'|'.join(prefixes)}) ", "")
    back = lambda c: F.regexp_replace(c, f" ({'|'.join(suffixes)})$", "")
    return F.array_distinct(F.array(name, front, back(name), back(front)))


def differences(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose two values differ, a null against a value included, in the order given."""
    marks = [F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in fields.items()]
    return F.array_compact(F.array(*marks))


def raised(priority: dict[str, int], old: Column, new: Column) -> Column:
    """Whether a new basis may replace the old one: it ranks at least as high; unknown and null bases rank 0."""
    rank = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in priority.items()], F.lit(0))
    return rank(new) >= rank(old)


def nearest_mention(mentions: DataFrame, key: str, place: str, anchor: str, bonuses: list[tuple[int, int]], base: Column) -> DataFrame:
    """The best mention of each key: base points and a bonus by distance to the anchor, then the earlier place."""
    gap = F.abs(F.col(place) - F.col(anchor))
    bonus = F.lit(0)
    for most, points in sorted(bonuses, reverse=True):
        bonus = F.when(gap <= most, points).otherwise(bonus)
    scored = mentions.withColumn("points", (base + bonus).cast("int"))
    best = Window.partitionBy(key).orderBy(F.desc("points"), place)
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
