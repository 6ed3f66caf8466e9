"""Connected components, by stars and by one task, against a plain union."""

from __future__ import annotations

import random

import pytest

from quillmart.operators import components, hot


def plain(edges):
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {i: top(i) for i in root}


def graphs():
    rnd = random.Random(1)
    hub = [(0, i) for i in range(1, 300)] + [(900, i) for i in range(250, 500)]
    return {"chain": [(i + 1, i) for i in range(40)], "hub": hub, "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)], "none": [], "odd": [(None, 1), (3, 3), (5, 2), (5, 2), (2, 5)]}


@pytest.mark.parametrize("few", [0, 1 << 18])
@pytest.mark.parametrize("name", sorted(graphs()))
def test_components_equal_a_plain_union(spark, monkeypatch, name, few):
    monkeypatch.setattr(components, "FEW_EDGES", few - 1)
    monkeypatch.setattr(hot, "LEAST_ROWS", 16)
    edges = graphs()[name]
    got = components.connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in got} == plain(edges) and len(got) == len(plain(edges))


def test_components_of_names(spark):
    got = components.connected_components(spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "y")], "x string, y string"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in got} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_join_of_a_hot_key_equals_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_ROWS", 5)
    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 1), (3, 1)] + [(9, i) for i in range(20)], "k long, v long")
    known = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four")], "k long, w string")
    keys = hot.hot_keys(rows, "k")
    assert {r["k"] for r in keys.collect()} == {1, 9} and hot.hot_keys(rows.limit(3), "k") is None
    for how in ("inner", "left"):
        want = sorted(map(repr, rows.join(known, "k", how).collect()))
        assert sorted(map(repr, hot.join_unique(rows, known, "k", keys, how).collect())) == sorted(map(repr, hot.join_unique(rows, known, "k", None, how).collect())) == want


def test_local_trees_connect_what_edges_connect_with_fewer_edges(spark, monkeypatch):
    from quillmart.operators import components as C

    monkeypatch.setattr(C, "TAKEN", 8)
    edges = [(a, b, a + b) for a in range(12) for b in range(a + 1, 12)] + [(20 + i, 21 + i, i) for i in range(9)] + [(5, 5, 99)]
    kept = C._trees  # one task, taken up in runs of eight edges
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"a": [a], "b": [b], "v": [v], "k": [True]}) for a, b, v in edges[:-1]]
    got = [r for x in kept(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    assert sorted(got) == sorted([(0, b, 21) for b in range(1, 12)] + [(20, 21 + i, 8) for i in range(9)])
    df = spark.createDataFrame(edges, "l long, r long, v int").repartition(1)
    assert sorted(map(tuple, C.local_trees(df, "l", "r", "v").collect())) == sorted(got)
    assert C.local_trees(df.limit(0), "l", "r").collect() == []
