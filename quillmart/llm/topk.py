"""Exact top-k inner products with multi-resolution segment statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import durable

#: Rows of a block of candidates and of a block of queries that meet in one task.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048
#: Segments of the resolutions, coarse to fine; one with more segments than half the components is left out.
RESOLUTIONS = (8, 16, 32)
#: Queries and candidates of a tile, within which bounds are held, and pairs that are gathered at once.
TILE_QUERIES, TILE_CANDIDATES, GATHERED = 256, 1024, 1 << 14
#: Rows of the pilot, which gives first floors and the rotation, and numbers that it may hold; the widest rotation.
PILOT_ROWS, PILOT_NUMBERS, WIDEST_ROTATION = 4096, 1 << 21, 1024
_SCHEMA = "query_id long, query_no int, vec_id long, score long"


@dataclass
class Basis:
    """Orthonormal coordinates for the statistics, and the cuts of their segments at every resolution."""

    rotation: np.ndarray | None
    cuts: list[list[int]]


def _cuts(energy: np.ndarray, segments: int) -> list[int]:
    """Starts of segments with about equal energy, one component each at least."""
    n = len(energy)
    share = np.cumsum(energy + energy.mean() * 1e-3 + 1e-12)
    at = np.searchsorted(share, share[-1] * np.arange(1, segments) / segments) + 1
    starts = [0]
    for i, x in enumerate(at):
        starts.append(int(min(max(x, starts[-1] + 1), n - (segments - 1 - i))))
    return starts


def basis_of(pilot: np.ndarray, width: int) -> Basis:
    """Principal axes of the pilot, largest energy first; the given coordinates where they are too many or unknown."""
    rotation, energy = None, np.ones(max(1, width))
    if 2 <= width <= WIDEST_ROTATION and len(pilot) > 1 and np.abs(pilot).max() > 0:
        scaled = pilot / np.abs(pilot).max()
        values, axes = np.linalg.eigh(scaled.T @ scaled)
        rotation, energy = axes[:, ::-1].copy(), np.maximum(values[::-1], 0)
    wanted = [s for s in RESOLUTIONS if 2 * s <= width] or [1]
    return Basis(rotation, [_cuts(energy, s) for s in wanted])


def summary(v: np.ndarray, starts: list[int]) -> np.ndarray:
    """Means and deviations of the segments, scaled by the root of their length, side by side.

    With d the distance, d^2 >= sum over segments of n * ((mean - mean')^2 + (dev - dev')^2); since a segment's
    squared norm is n * (mean^2 + dev^2), the inner product is at most the product of two such summaries.
    """
    if not v.shape[1]:
        return np.zeros((len(v), 1))
    sizes = np.diff([*starts, v.shape[1]])
    mean = np.add.reduceat(v, starts, axis=1) / sizes
    apart = v - np.repeat(mean, sizes, axis=1)
    return np.concatenate([mean * np.sqrt(sizes), np.sqrt(np.add.reduceat(apart * apart, starts, axis=1))], 1)


def _held(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, x))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with rows of c, one by one, as 64-bit integers held to their range."""
    if q.size == 0 or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    return np.array([_held(sum(int(x) * int(y) for x, y in zip(a, b, strict=True))) for a, b in zip(q, c, strict=True)], np.int64)


class Search:
    """The k best candidates of each query of a block, tile by tile; memory does not grow with the survivors.

    A query's floor is a score that k candidates are known to reach. In a tile, bounds go from coarse to fine and a
    pair lives while its bound reaches the floor of its query; living pairs are computed exactly, by one dense product
    where more than a quarter of them live, else gathered in slices; then the floors rise.
    """

    def __init__(self, query_ids, queries, floors, k: int, basis: Basis):
        self.ids, self.queries, self.k, self.basis = query_ids, queries, k, basis
        self.floors = np.array(floors, np.float64)
        self.sums, self.norms = self._statistics(queries), np.linalg.norm(queries, axis=1)
        self.small = np.abs(queries).max(initial=0)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)  # scores, ids
        self.pairs, self.alive = 0, [0] * len(basis.cuts)

    def _statistics(self, v: np.ndarray) -> list[np.ndarray]:
        turned = v if self.basis.rotation is None else v @ self.basis.rotation
        return [summary(turned, c) for c in self.basis.cuts]

    def see(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray) -> None:
        for at in range(0, len(ids), TILE_CANDIDATES):
            cut = slice(at, at + TILE_CANDIDATES)
            sums, norms = self._statistics(vectors[cut]), np.linalg.norm(vectors[cut], axis=1)
            for first in range(0, len(self.queries), TILE_QUERIES):
                self._tile(slice(first, first + TILE_QUERIES), ids[cut], vectors[cut], copies[cut], sums, norms)

    def _tile(self, part: slice, ids, vectors, copies, sums, norms) -> None:
        queries, floor = self.queries[part], self.floors[part, None]
        slack = 1e-9 * (1.0 + self.norms[part, None] * norms[None, :])
        live = np.ones((len(queries), len(ids)), bool)
        self.pairs += live.size
        for level, (a, b) in enumerate(zip(self.sums, sums, strict=True)):
            if 4 * np.count_nonzero(live) > live.size:
                live &= a[part] @ b.T + slack >= floor
            else:
                qi, ci = np.nonzero(live)
                for x in range(0, len(qi), GATHERED):
                    q, c = qi[x : x + GATHERED], ci[x : x + GATHERED]
                    live[q, c] = np.einsum("ij,ij->i", a[part][q], b[c]) + slack[q, c] >= floor[q, 0]
            self.alive[level] += int(np.count_nonzero(live))
        qi, ci = np.nonzero(live)
        if not len(qi):
            return
        if 4 * len(qi) > live.size and self.small * np.abs(vectors).max(initial=0) * max(1, vectors.shape[1]) < 2.0**53:
            score = (queries @ vectors.T)[qi, ci].astype(np.int64)
        else:
            score = np.concatenate([_exact(queries[qi[x : x + GATHERED]], vectors[ci[x : x + GATHERED]]) for x in range(0, len(qi), GATHERED)])
        good = score >= self.floors[part][qi]
        qi, ci, score = qi[good], ci[good], score[good]
        ends = np.searchsorted(qi, np.arange(len(queries) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            cut, at = slice(ends[i], ends[i + 1]), (part.start or 0) + i
            c, s = ci[cut], score[cut]
            times = copies[c].copy()
            own = np.flatnonzero(ids[c] == self.ids[at])
            times[own[(vectors[c[own]] == queries[i]).all(1)]] -= 1  # the query's own row
            times = np.minimum(times, self.k)
            self._keep(at, np.repeat(s, times), np.repeat(ids[c], times))

    def _keep(self, at: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.best[at][0], score), np.append(self.best[at][1], ids)
        order = np.lexsort((ids, -score))[: self.k]
        self.best[at] = score[order], ids[order]
        if len(order) == self.k:
            self.floors[at] = max(self.floors[at], float(score[order[-1]]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _searched(k: int, bases: dict[int, Basis]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            queries, vectors = _matrix(left["v"]), _matrix(right["v"])
            ids, numbers = left["vec_id"].to_numpy(), left["query_no"].to_numpy()
            search = Search(ids, queries, left["floor"].to_numpy(), k, bases.get(queries.shape[1]) or basis_of(vectors[:0], queries.shape[1]))
            search.see(right["vec_id"].to_numpy(), vectors, right["copies"].to_numpy())
            sizes = [len(s) for s, _ in search.best]
            columns = [np.repeat(ids, sizes), np.repeat(numbers, sizes), np.concatenate([i for _, i in search.best]), np.concatenate([s for s, _ in search.best])]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query_id", "query_no", "vec_id", "score"])

    return run


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with floor(scale * x) of every component; rows with null or non-finite parts are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _pilot(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and copies by width of the rows with the smallest hashes: PILOT_ROWS rows, PILOT_NUMBERS numbers."""
    wide = vectors.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    rows = min(PILOT_ROWS, max(64, PILOT_NUMBERS // wide))
    table = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(rows).toArrow()
    widths = np.array([len(x) for x in table["v"]], np.int64)
    out = {}
    for w in np.unique(widths).tolist():
        part = table.filter(pa.array(widths == w))
        out[w] = part["vec_id"].to_numpy(), _matrix(part["v"]), part["copies"].to_numpy()
    return out


def _floored(k: int, shared):
    """Adds to every query the score that k rows of the pilot reach; minus infinity where they are fewer."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(at, QUERY_BLOCK)
                widths = np.array([len(x) for x in batch["v"]], np.int64)
                floor = np.full(batch.num_rows, -np.inf)
                for w in np.unique(widths).tolist():
                    if w in shared.value[0]:
                        mine = np.flatnonzero(widths == w)
                        part = batch.take(pa.array(mine))
                        search = Search(part["vec_id"].to_numpy(), _matrix(part["v"]), floor[mine], k, shared.value[1][w])
                        search.see(*shared.value[0][w])
                        floor[mine] = search.floors
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, query_no, rank, vec_id, score: the k largest inner products of each query, ties to the smaller vec_id.

    Queries and candidates are (vec_id, v) of whole numbers. A pilot of bounded size gives every query a floor before
    the search, and the axes in which segment statistics are taken. Both sides are dealt into blocks of bounded size
    by hash of the row, and every block of queries meets every block of candidates in a task of its own, where bounds
    of the segments, coarse to fine, leave few exact products; a task returns k rows a query at most, which are ranked
    per query. Queries are the stated set, so this is blocked search, not a join of all pairs.

    A query's own row is no candidate; other rows with its id are. Rows that are equal in id and vector are counted
    before they move, and are candidates one by one; a query that repeats with the same vector counts once. Queries of
    one id with different vectors have their own lists, numbered by query_no (from 1, by vector). Vectors meet only
    vectors of their own length; empty vectors score 0. Scores outside 64 bits are held to the range. No usable row
    gives no rows.
    """
    # written once: two counts, the pilot and the search read it
    vectors = durable(vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")))
    numbered = queries.select("vec_id", "v").distinct().withColumn("query_no", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))
    n, m = vectors.count(), numbered.count()
    pilot = _pilot(vectors)
    bases = {w: basis_of(v, w) for w, (_, v, _) in pilot.items()}
    shared = vectors.sparkSession.sparkContext.broadcast((pilot, bases))  # PILOT_NUMBERS numbers, and square rotations
    floored = numbered.mapInArrow(_floored(k, shared), "vec_id long, v array<double>, query_no int, floor double")

    spread, slots = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("long")
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    dealt = vectors.select("vec_id", "v", "copies", F.size("v").alias("width"), deal(spread).alias("block"), every(slots).alias("slot"))
    asked = floored.select("vec_id", "v", "query_no", "floor", F.size("v").alias("width"), deal(slots).alias("slot"), every(spread).alias("block"))
    keys = ["width", "slot", "block"]
    met = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_searched(k, bases), _SCHEMA)
    best = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query_no", "rank", "vec_id", "score")


def search_queries(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """top_k of the rows whose vec_id is divisible by ``every`` against all rows."""
    vectors = quantised(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT vec_id, v, row_number() OVER (ORDER BY vec_id, v) AS place FROM v
), q AS (
  SELECT vec_id, v, min(place) AS place, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY v) AS INTEGER) AS query_no FROM n WHERE vec_id % 100 = 0 GROUP BY vec_id, v
), s AS (
  SELECT q.vec_id AS query_id, query_no, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN n c ON q.place <> c.place AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, query_no, CAST(row_number() OVER (PARTITION BY query_id, query_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, query_no, rank, vec_id, score FROM r WHERE rank <= 10
"""
