"""Merges of entities: redirects followed to their end, children moved with their collisions, targets without cycles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.durable import durable
from quillmart.operators.hot import hot_keys, join_unique


def _jumped(links: DataFrame, table: DataFrame) -> DataFrame:
    """Links (a, to, least) taken on by those of the table; ``ends`` where none follows, ``least`` is the smallest passed."""
    follow = table.select(F.col("a").alias("to"), F.col("to").alias("next"), F.col("least").alias("further"))
    joined = join_unique(links, follow, "to", hot_keys(links, "to"), "left")
    ends = F.col("next").isNull()
    return joined.select("a", F.coalesce("next", "to").alias("to"), F.when(ends, F.col("least")).otherwise(F.least("least", "further")).alias("least"), ends.alias("ends"))


def followed(links: DataFrame, node: str, target: str) -> DataFrame:
    """(node, target, cyclic): where each node leads in the end; one that leads into a cycle is ``cyclic``.

    ``links`` has one target a node; null ends and loops are ignored. Links are doubled: after k rounds a node has gone
    2 ** k steps, so chains of any length take a logarithmic number of rounds, and nodes that have ended are not joined
    again. A target that very many nodes have is no task of its own.
    """
    rest = durable(links.select(F.col(node).alias("a"), F.col(target).alias("to")).where("a <> to").withColumn("least", F.col("to")))
    most, ended = math.ceil(math.log2(max(rest.count(), 2))) + 2, []
    for _ in range(most):
        if rest.isEmpty():
            break
        new = durable(_jumped(rest, reduce(DataFrame.unionByName, ended, rest)))
        ended.append(new.where("ends").drop("ends"))
        rest = new.where("NOT ends").drop("ends")
    out = reduce(DataFrame.unionByName, [x.withColumn("cyclic", F.lit(False)) for x in ended], rest.withColumn("cyclic", F.lit(True)))
    return out.select(F.col("a").alias(node), F.col("to").alias(target), "cyclic")


def without_cycles(links: DataFrame, node: str, target: str) -> DataFrame:
    """The links with ``breaks``: of each cycle the link of its smallest node, without which the rest has none."""
    ends = followed(links, node, target).where("cyclic")
    if ends.isEmpty():
        return links.withColumn("breaks", F.lit(False))
    # among nodes that lead into a cycle, those on one are reached after any number of steps
    inside = durable(links.join(ends.select(node), node, "left_semi").select(F.col(node).alias("a"), F.col(target).alias("to"), F.col(target).alias("least")))
    size = inside.count()
    steps = inside
    for _ in range(math.ceil(math.log2(max(size, 2))) + 1):
        steps = durable(_jumped(steps, steps).drop("ends"))
    on = steps.select(F.col("to").alias("a")).distinct()
    smallest = steps.join(on, "a", "left_semi").where("a = least").select(F.col("a").alias(node), F.lit(True).alias("breaks"))
    return links.join(smallest, node, "left").withColumn("breaks", F.coalesce("breaks", F.lit(False)))


def moved_children(child: DataFrame, key: str, natural: list[str], mapping: DataFrame, hot: tuple[DataFrame | None] | None = None) -> DataFrame:
    """Children after their parents' merge: ``key`` moved, one row for each natural key (key and ``natural``).

    Of rows that collide the one that was there stays, else that of the smallest former parent; ``came_from`` is its
    former parent, ``rows`` and ``moved`` are how many rows met and how many of them moved. ``mapping`` is
    (duplicate_id, canonical_id), unique by duplicate. Rows of a parent with very many children stay in place, and
    rows that collide are combined before they move. ``hot`` holds such parents where they are known already, as
    counting them works the child table out twice more.
    """
    others = [c for c in child.columns if c not in (key, *natural)]
    target = mapping.select(F.col("duplicate_id").alias(key), F.col("canonical_id").alias("_to"))
    filled = child.where(F.col(key).isNotNull())
    joined = join_unique(filled, target, key, hot_keys(filled, key) if hot is None else hot[0], "left").unionByName(child.where(F.col(key).isNull()).withColumn("_to", F.lit(None)))
    went = F.col("_to").isNotNull()
    row = F.min(F.struct(went.alias("went"), F.col(key).alias("was"), *others)).alias("row")
    met = joined.groupBy(F.coalesce("_to", key).alias("_key"), *natural).agg(row, F.count(F.lit(1)).alias("rows"), F.count_if(went).alias("moved"))
    return met.select(F.col("_key").alias(key), *natural, *[F.col(f"row.{c}") for c in others], F.col("row.was").alias("came_from"), "rows", "moved")


def merge_counts(children: dict[str, DataFrame]) -> DataFrame:
    """One row for each table of moved children: rows before, moved, collisions, rows after."""
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rows = [df.agg(some("rows").alias("before"), some("moved").alias("moved"), (some("rows") - F.count(F.lit(1))).alias("collisions"), F.count(F.lit(1)).alias("after")).select(F.lit(name).alias("child"), "*") for name, df in children.items()]
    return reduce(DataFrame.unionByName, rows)


def nested_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[Column], Column]], most: int) -> DataFrame:
    """Each parent with an array for each child table: its first ``most`` items (text) in order.

    ``children`` are name: (table with the parent's key, order, item). All tables are one union, ranked and cut before
    it moves (a task sends ``most`` rows of a parent and table at most), and gathered by one grouping, instead of a
    join for each table. Parents without children have empty arrays.
    """
    return _with_lists(parents, key, _gathered(key, children, most), list(children))


def _gathered(key: str, children: dict[str, tuple[DataFrame, list[Column], Column]], most: int) -> DataFrame:
    tagged = []
    for name, (table, order, item) in children.items():
        # orders of different tables are compared within their table only, as sortable texts
        tagged.append(table.select(key, F.lit(name).alias("_tag"), F.concat_ws("\x01", *order).alias("_order"), item.cast("string").alias("_item")))
    place = F.row_number().over(Window.partitionBy(key, "_tag").orderBy("_order", "_item"))
    first = reduce(DataFrame.unionByName, tagged).withColumn("_n", place).where(F.col("_n") <= most)
    return first.groupBy(F.col(key).alias("_key")).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("_tag") == name, F.struct("_n", "_item")))), lambda x: x["_item"]).alias(name) for name in children])


def _with_lists(parents: DataFrame, key: str, gathered: DataFrame, names: list[str]) -> DataFrame:
    joined = parents.join(gathered, F.col(key) == F.col("_key"), "left")
    return joined.select(*parents.columns, *[F.coalesce(name, F.array().cast("array<string>")).alias(name) for name in names])


def nested_lists(parents: DataFrame, key: str, table: DataFrame, lists: dict[str, tuple[list[Column], Column, Column | None]], most: int) -> DataFrame:
    """``nested_children`` where all lists are of one table: name: (order, item, test of its rows or None).

    A row moves once with what all lists want of it, and the lists are sorted and cut in the row of their parent. Rows
    of a parent with very many children are ranked and cut where they are instead, as those of ``nested_children``.
    """
    rows = table.where(F.col(key).isNotNull())
    hot = hot_keys(rows, key)
    keys = None if hot is None else F.broadcast(hot.select(key))
    few = rows if keys is None else rows.join(keys, key, "left_anti")
    entry = lambda order, item: F.struct(F.concat_ws("\x01", *order).alias("o"), item.cast("string").alias("i"))
    listed = [F.collect_list(entry(order, item) if test is None else F.when(test, entry(order, item))).alias(name) for name, (order, item, test) in lists.items()]
    # moved as they are: the texts of orders and items are made where the lists are
    grouped = few.repartition(key).groupBy(F.col(key).alias("_key")).agg(*listed)
    gathered = grouped.select("_key", *[F.slice(F.sort_array(name), 1, most)["i"].alias(name) for name in lists])
    if keys is not None:
        many = rows.join(keys, key, "left_semi")
        gathered = gathered.unionByName(_gathered(key, {name: (many if test is None else many.where(test), order, item) for name, (order, item, test) in lists.items()}, most))
    return _with_lists(parents, key, gathered, list(lists))
