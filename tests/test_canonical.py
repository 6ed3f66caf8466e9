"""Redirects, cycles, moved children and nested children against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillmart.operators import canonical as K

LINKS = "duplicate_id long, canonical_id long"


def walk(links):
    """{node: (end, cyclic)} by following one link after another."""
    to = {a: b for a, b in links if a is not None and b is not None and a != b}
    out = {}
    for a in to:
        seen, at = {a}, to[a]
        while at in to and at not in seen:
            seen.add(at)
            at = to[at]
        out[a] = (at if at not in to else None, at in to)
    return out


def on_cycles(links):
    to = {a: b for a, b in links if a is not None and b is not None and a != b}
    smallest = set()
    for a in to:
        seen, at = [a], to[a]
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        if at in seen and at in to:
            smallest.add(min(seen[seen.index(at) :]))
    return smallest


def followed(spark, links):
    rows = K.followed(spark.createDataFrame(links, LINKS), "duplicate_id", "canonical_id").collect()
    return {r["duplicate_id"]: (None if r["cyclic"] else r["canonical_id"], r["cyclic"]) for r in rows}


def test_chains_of_any_length_end_where_they_end(spark):
    links = [(i, i - 1) for i in range(1, 400)] + [(1000 + i, 7) for i in range(300)] + [(2000, None), (None, 3), (2001, 2001)]
    assert followed(spark, links) == walk(links) and set(followed(spark, links).values()) == {(0, False)}
    assert followed(spark, []) == {}


def test_cycles_are_told_apart_and_broken_once(spark):
    links = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 7), (8, 9), (9, 8), (10, 11)]
    assert followed(spark, links) == walk(links)
    broken = K.without_cycles(spark.createDataFrame(links, LINKS), "duplicate_id", "canonical_id").where("breaks").collect()
    assert {r["duplicate_id"] for r in broken} == on_cycles(links) == {1, 8}


def test_random_links(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        links = [(i, rnd.randrange(60)) for i in rnd.sample(range(60), 45)]
        assert followed(spark, links) == walk(links)
        marked = K.without_cycles(spark.createDataFrame(links, LINKS), "duplicate_id", "canonical_id")
        assert {r["duplicate_id"] for r in marked.where("breaks").collect()} == on_cycles(links)
        rest = {(r["duplicate_id"], r["canonical_id"]) for r in marked.where("NOT breaks").collect()}
        assert not any(cyclic for _, cyclic in walk(sorted(rest)).values())


def test_children_move_and_collide_once(spark):
    rnd = random.Random(4)
    mapping = {i: i % 5 for i in range(5, 40)}
    child = [(rnd.choice([None, *range(50)]), rnd.randrange(4), f"note {i}") for i in range(400)] + [(7, 100 + i, "hot") for i in range(2000)]
    rows = K.moved_children(spark.createDataFrame(child, "part long, link long, note string"), "part", ["link"], spark.createDataFrame(list(mapping.items()), LINKS))
    met = defaultdict(list)
    for part, link, note in child:
        met[mapping.get(part, part), link].append((part in mapping, part is not None, part or 0, note))
    wanted = {k: (min(v)[3], min(v)[2] if min(v)[1] else None, len(v), sum(x[0] for x in v)) for k, v in met.items()}
    assert {(r["part"], r["link"]): (r["note"], r["came_from"], r["rows"], r["moved"]) for r in rows.collect()} == wanted
    counts = K.merge_counts({"links": rows}).collect()[0]
    assert tuple(counts) == ("links", len(child), sum(p in mapping for p, _, _ in child), len(child) - len(wanted), len(wanted))


def test_nothing_to_move(spark):
    none = spark.createDataFrame([], LINKS)
    rows = K.moved_children(spark.createDataFrame([(1, 2)], "part long, link long"), "part", ["link"], none).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 1, 1, 0)]
    empty = K.moved_children(spark.createDataFrame([], "part long, link long"), "part", ["link"], none)
    assert tuple(K.merge_counts({"x": empty}).collect()[0]) == ("x", 0, 0, 0, 0)


def test_nested_children_keep_order_and_bound(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    many = spark.createDataFrame([(1, i) for i in range(500)] + [(3, 1), (None, 5)], "id long, n int")
    few = spark.createDataFrame([(2, "x"), (2, None), (1, "y")], "id long, t string")
    got = K.nested_children(parents, "id", {"many": (many, [F.lpad(F.col("n").cast("string"), 4, "0")], F.col("n")), "few": (few, [F.col("t")], F.col("t"))}, 3)
    rows = {r["name"]: (r["many"], r["few"]) for r in got.collect()}
    assert rows["a"] == (["0", "1", "2"], ["y"]) and rows["c"] == ([], []) and rows["b"][0] == [] and sorted(rows["b"][1], key=str) == [None, "x"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # cut before the rows move


def test_hot_parents_are_counted_once_a_source(spark, sf_dir, monkeypatch):
    from quillmart.plans import canonical as plan

    counted = []
    noted = lambda rows, key, total=None: counted.append(key)
    monkeypatch.setattr(plan, "hot_keys", noted)
    mapping = spark.createDataFrame([(2, 1), (3, 1)], "duplicate_id long, canonical_id long")
    monkeypatch.setattr(plan, "redirects", lambda spark, d: mapping)
    monkeypatch.setattr(plan.K, "hot_keys", noted)
    assert plan.merge_application(spark, sf_dir).count() == len(plan.CHILDREN)
    assert len(counted) == 2


def test_lists_of_one_table_move_their_rows_once(spark, sf_dir):
    """As many child tables would give, with and without a parent of very many children."""
    from quillmart import plans

    rows = [(1, i % 7, i) for i in range(900)] + [(2, 3, 1), (2, None, 2), (3, None, None), (None, 1, 1)] + [(i, 1, i) for i in range(10, 60)]
    child = spark.createDataFrame(rows, "id long, a int, b int")
    parents = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w"), (None, "n"), (20, "v")], "id long, name string")
    for table in (child, child.where("b < 20 OR b IS NULL")):
        text = lambda c: F.lpad(F.col(c).cast("string"), 4, "0")
        lists = {"one": ([text("a")], F.col("b"), None), "two": ([text("b")], F.concat_ws("/", "a", "b"), F.col("a") > 1)}
        children = {name: (table if test is None else table.where(test), order, item) for name, (order, item, test) in lists.items()}
        got, expected = K.nested_lists(parents, "id", table, lists, 3), K.nested_children(parents, "id", children, 3)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    plan = plans.QUERIES["parts_with_children"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Window" not in plan
