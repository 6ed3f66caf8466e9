"""Connected components by star contraction of the edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillmart.functions.durable import durable
from quillmart.operators.hot import hot_keys, join_unique

#: So many edges at most are joined in a single task.
FEW_EDGES = 1 << 18


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The distinct edges, checkpointed, with their number and a sum of hashes, both counted on the way."""
    seen = Observation()
    marked = edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    done = durable(marked)
    return done, (seen.get["n"], int(seen.get["h"] or 0))


def _starred(edges: DataFrame, total: int, hub: str) -> DataFrame:
    """Edges (hub, other) with the least neighbour of the hub as ``least``; a hub with many edges is no single task."""
    least = edges.groupBy(hub).agg(F.min("other").alias("least"))
    return join_unique(edges, least, hub, hot_keys(edges, hub, total))


def _roots(ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of edges in order, the place of each node's root, and that of each edge's first end."""
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = place[: len(ends[0])], place[len(ends[0]) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, root, a


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) of one task: roots are hooked to smaller ones and pointers compressed."""
    batches = list(batches)
    if not sum(x.num_rows for x in batches):
        return
    table = pa.Table.from_batches(batches)
    nodes, root, _ = _roots([table[c].to_numpy(zero_copy_only=False) for c in ("a", "b")])
    kind = table.schema.field("a").type
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], names=["node", "component"])


#: Edges that a task takes up at a time.
TAKEN = 1 << 20


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One star for each component of a task's edges, each edge with the largest value of the component."""
    none = np.zeros(0, np.int64)
    kept, waiting, held = (none, none, none), [], 0

    def joined():
        ends = [np.concatenate([k, *(w[i] for w in waiting)]) for i, k in enumerate(kept)]
        nodes, root, a = _roots(ends[:2])
        most = np.full(len(nodes), np.iinfo(np.int64).min)
        np.maximum.at(most, root[a], ends[2])
        other = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[root[other]], nodes[other], most[root[other]]

    for batch in batches:
        batch = batch.filter(batch.column(3))
        waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        held += batch.num_rows
        if held >= max(TAKEN, len(kept[0])):
            kept, waiting, held = joined(), [], 0
    if held:
        kept = joined()
    for at in range(0, len(kept[0]), TAKEN):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + TAKEN]) for x in kept], names=["a", "b", "v"])


def local_trees(edges: DataFrame, left: str, right: str, value: str | None = None, where: Column | None = None) -> DataFrame:
    """Edges (left, right, and value if there is one) that connect what the edges connect, fewer than a task has nodes.

    Nodes and values are integers. Edges are taken up as they are made, so a task holds its nodes, not its edges;
    values are the largest of an edge's own task and component. ``where`` tells which edges count; it is judged in the
    row, since a filter would repeat the rules behind it for each condition.
    """
    counts = F.col(left) != F.col(right) if where is None else where & (F.col(left) != F.col(right))
    v = F.lit(0) if value is None else F.col(value)
    rows = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"), v.cast("long").alias("v"), F.coalesce(counts, F.lit(False)).alias("k"))
    trees = rows.mapInArrow(_trees, "a long, b long, v long")
    return trees.select(F.col("a").alias(left), F.col("b").alias(right), *([F.col("v").cast(edges.schema[value].dataType).alias(value)] if value else []))


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Large and small stars alternate: every node hands its larger neighbours to the smallest node it knows, then its
    smaller ones, until each component is one star around its smallest node. That takes a logarithmic number of rounds,
    long chains included, with a checkpoint each. A graph of at most FEW_EDGES distinct edges is joined by one task
    instead. Edges with a null end and loops are ignored; no edges give no rows. Two numbers a round reach the driver.
    """
    rest = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    rest, state = _written(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    if state[0] <= FEW_EDGES:
        kind = rest.schema["a"].dataType.simpleString()
        return rest.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    while True:
        both = rest.select(F.col("a").alias("hub"), F.col("b").alias("other")).unionByName(rest.select(F.col("b").alias("hub"), F.col("a").alias("other")))
        large = _starred(both, 2 * state[0], "hub").where("other > hub").select(F.least("hub", "least").alias("a"), F.col("other").alias("b"))
        down = _starred(large.distinct().select(F.col("b").alias("hub"), F.col("a").alias("other")), state[0], "hub")
        small = down.select(F.col("least").alias("a"), F.explode(F.array("hub", "other")).alias("b")).where("a <> b")
        rest, new = _written(small)
        if new == state:
            break
        state = new
    return rest.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(rest.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
