"""Merkle manifest of a dataset: a tree for each source under one root, with an inclusion proof for every row."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import crc32_sql, durable, source_key

#: Children of a node, and levels that one traversal takes: blocks have ARITY ** LEVELS nodes, so their roots are aligned.
ARITY, LEVELS = 16, 3


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(nodes: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


def traverse(leaves: list[str], levels: int, proofs: list[list[tuple[str, str]]] | None) -> str:
    """Root of the leaves, in postorder; while it unwinds, a node's siblings are added to every leaf that it contains.

    A proof is (siblings on the left, siblings on the right) for each level, each as joined digests.
    """

    def visit(first: int, level: int) -> str:
        if level == 0:
            return leaves[first]
        width = ARITY ** (level - 1)
        starts = range(first, min(first + ARITY * width, len(leaves)), width)
        children = [visit(at, level - 1) for at in starts]
        if proofs is not None:
            for k, at in enumerate(starts):
                siblings = ("".join(children[:k]), "".join(children[k + 1 :]))
                for i in range(at, min(at + width, len(leaves))):
                    proofs[i].append(siblings)
        return digest_of(children)

    return visit(0, levels)


def fold(digest: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf gives with its siblings."""
    for left, right in proof:
        digest = digest_of([left, digest, right])
    return digest


def packed(proof: list[tuple[str, str]]) -> str:
    """A proof as text: sides of a level parted by a comma, levels by a semicolon."""
    return "".join(f"{left},{right};" for left, right in proof)


def unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split(",")) for level in path.split(";")[:-1]]  # type: ignore[misc]


Emit = Callable[[dict, list[list[tuple[str, str]]] | None, str], dict[str, list]]


def _blocks(batches: Iterator[pa.RecordBatch], emit: Emit, schema: list[tuple[str, pa.DataType]], with_proofs: bool, levels: int) -> Iterator[pa.RecordBatch]:
    """Traverse each block of a sorted stream of nodes; a block may begin with a row of what lies above it (idx -1)."""
    held: dict[str, list] = {}
    key, size = None, ARITY**levels

    def done() -> dict[str, list]:
        above = held["idx"][0] < 0
        nodes = held["digest"][above:]
        total = held["total"][-1]
        proofs = [[] for _ in nodes] if with_proofs else None
        return emit(held, proofs, traverse(nodes, levels if total > size else height(total), proofs))

    out: dict[str, list] = {name: [] for name, _ in schema}

    def ready() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in schema], names=[n for n, _ in schema])
        for n in out:
            out[n] = []
        return batch

    for batch in batches:
        columns = {n: batch[n].to_pylist() for n in batch.schema.names}
        for i in range(batch.num_rows):
            now = (columns["tree"][i], columns["idx"][i] // size if columns["idx"][i] >= 0 else columns["block"][i])
            if key is not None and now != key:
                for n, values in done().items():
                    out[n] += values
                held = {}
                if len(out[schema[0][0]]) >= 8192:
                    yield ready()
            key = now
            for n, values in columns.items():
                held.setdefault(n, []).append(values[i])
    if held:
        for n, values in done().items():
            out[n] += values
    yield ready()


def _root_of_block(held: dict, proofs, root: str) -> dict[str, list]:
    return {"tree": [held["tree"][0]], "idx": [held["block"][0]], "total": [held["blocks"][-1]], "digest": [root]}


def _paths_of_block(held: dict, proofs, root: str) -> dict[str, list]:
    """Each node's whole path: its own siblings in the block, then what lies above the block."""
    above = held["path"][0] if held["idx"][0] < 0 else ""
    top = held["root"][0] if held["idx"][0] < 0 else root
    n = len(proofs)
    return {"tree": held["tree"][-n:], "idx": held["idx"][-n:], "path": [packed(p) + above for p in proofs], "root": [top] * n}


def _facts_of_block(held: dict, proofs, root: str, with_path: bool) -> dict[str, list]:
    """Each row's facts, its proof hashed and folded; the first row of a block brings the path above it and the root."""
    above = unpacked(held["path"][0])
    subroot, top = held["subroot"][0], held["root"][0]
    out: dict[str, list] = {n: [] for n in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")}
    tail = "".join(left + right for left, right in above)
    for k, own in enumerate(proofs, 1):
        given = held["digest"][k] if held["tampered"][k] is None else held["tampered"][k]
        folded = fold(fold(given, own), above)
        row = (held["doc_id"][k], held["digest"][k], subroot, top, digest_of([x for pair in own for x in pair] + [tail]), folded, folded == top, packed(own + above) if with_path else None)
        for n, value in zip(out, row, strict=True):
            out[n].append(value)
    return out


_ROOTS = [("tree", pa.string()), ("idx", pa.int64()), ("total", pa.int64()), ("digest", pa.string())]
_PATHS = [("tree", pa.string()), ("idx", pa.int64()), ("path", pa.string()), ("root", pa.string())]
_FACTS = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("proof", pa.string())]
_SQL = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}


def _traversed(nodes: DataFrame, emit: Emit, schema: list, with_proofs: bool, levels: int) -> DataFrame:
    """Blocks of the nodes, wherever they are of one tree, each in one task; one task takes many blocks after another."""
    size = ARITY**levels
    dealt = nodes.withColumn("block", F.when(F.col("idx") >= 0, F.expr(f"idx div {size}")).otherwise(F.col("total"))).withColumn("blocks", F.expr(f"(total + {size - 1}) div {size}"))
    ordered = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    return ordered.mapInArrow(functools.partial(_blocks, emit=emit, schema=schema, with_proofs=with_proofs, levels=levels), ", ".join(f"{n} {_SQL[t]}" for n, t in schema))


def _above(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Paths of block roots as first rows of their blocks: idx is -1 and ``total`` is the block."""
    return rows.select("tree", F.lit(-1).cast("long").alias("idx"), F.col("idx").alias("total"), *columns)


def _ascend(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Paths (tree, idx, path, root) of the nodes (tree, idx, total, digest), and roots (tree, digest) of the trees.

    Roots of blocks are the nodes of another traversal until every tree is one block; their paths then come down.
    There is a round for every ``levels`` of the largest tree: three for 10 ** 10 nodes.
    """
    blocks = durable(_traversed(nodes, _root_of_block, _ROOTS, False, levels))
    if blocks.where("total > 1").isEmpty():
        return _traversed(nodes, _paths_of_block, _PATHS, True, levels), blocks.select("tree", "digest")
    paths, roots = _ascend(blocks, levels)
    rows = nodes.select("tree", "idx", "total", "digest").unionByName(_above(durable(paths), ["path", "root"]), allowMissingColumns=True)
    return _traversed(rows, _paths_of_block, _PATHS, True, levels), roots


def _numbered(rows: DataFrame, tree: str, order: list[Column | str]) -> DataFrame:
    """``idx`` (from 0) of every row in its tree, and ``total``, the tree's rows; rows are written once.

    Rows are range-partitioned and sorted, so the rows of one tree are runs of some partitions. A run is counted
    before anything moves, the runs in front of it are its offset, and a row's idx is that and its place in the run.
    """
    placed = durable(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)).withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33))
    runs = placed.groupBy(tree, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(tree, "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(tree)).alias("total"))
    joined = placed.join(runs, [tree, "_p"])
    return joined.withColumn("idx", F.col("_o") + F.col("_at") - F.col("_first")).drop("_at", "_p", "_first", "_o")


def merkle_manifest(documents: DataFrame, tampered: Column | None = None, with_proof: bool = True, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and proof of every row.

    A leaf is the hash of doc_id, source, lang, n_chars and text. A source's leaves ascend by doc_id (null first), then
    by their hash; runs of sixteen nodes become their hash until one is left, the subroot. Subroots, ordered by source
    (null first, by UTF-8 bytes), likewise give the root. ``proof`` holds a leaf's siblings, level by level
    (``packed``); ``folded_root`` is what the leaf gives with them, and ``verified`` says whether it is the root.

    ``tampered`` is a text in whose place of the original the folding leaf is computed, null where that is kept.

    Only hashes and ids move. A source of any size is dealt over blocks of 16 ** ``levels`` leaves that are traversed
    separately; the block roots are traversed likewise. Null fields count as ``-``; a null source is one of its own;
    rows that repeat an id each have a leaf, equal rows have equal leaves at neighbouring places. An empty table gives
    no rows; other columns are ignored.
    """
    no_text = F.lit(None).cast("string")
    slim = documents.select("doc_id", source_key(F.col("source")).alias("tree"), leaf(F.col("text")).alias("digest"), leaf(tampered).alias("_t") if tampered is not None else no_text.alias("_t"), (tampered.isNotNull() if tampered is not None else F.lit(False)).alias("_is"))
    slim = slim.select("doc_id", "tree", "digest", F.when(F.col("_is") & (F.col("_t") != F.col("digest")), F.col("_t")).alias("tampered"), F.monotonically_increasing_id().alias("_u"))
    leaves = durable(_numbered(slim, "tree", ["doc_id", "digest", "_u"]).select("tree", "idx", "total", "digest", "tampered", "doc_id"))

    nodes = leaves.select("tree", "idx", "total", "digest")
    blocks = durable(_traversed(nodes, _root_of_block, _ROOTS, False, levels))
    paths, roots = _ascend(blocks, levels)
    # source_key orders as asked: "-" stands for null and sorts before "=" and the source
    subroots = roots.select(F.lit("").alias("all"), F.col("tree").alias("source_tree"), "digest")
    top = durable(_numbered(subroots, "all", ["source_tree"]).withColumnRenamed("all", "tree"))
    top_paths, _ = _ascend(top.select("tree", "idx", "total", "digest"), levels)
    tops = top.join(top_paths.withColumnRenamed("path", "top_path"), ["tree", "idx"]).select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "top_path", "root")
    above = paths.drop("root").join(tops, "tree").select("tree", "idx", F.concat("path", "top_path").alias("path"), "subroot", "root")
    rows = leaves.unionByName(_above(above, ["path", "subroot", "root"]), allowMissingColumns=True)
    return _traversed(rows, functools.partial(_facts_of_block, with_path=with_proof), _FACTS, True, levels)


def tampered_manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest where every fifth row's text, by crc32 of its id, is lower-cased before it is verified."""
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return merkle_manifest(documents, F.when(fifth, lower_ascii(F.col("text"))), with_proof=False, levels=levels).drop("proof")


_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))
_LEAF = f"sha256({_FIELDS} || CASE WHEN {{0}} IS NULL THEN '-' ELSE strlen({{0}}) || ':' || {{0}} END)"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIBLINGS = "coalesce(string_agg(h, '') OVER (PARTITION BY source, lv, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
_STEPS = f"{_SIBLINGS.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {_SIBLINGS.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r"
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, {_LEAF.format("text")} AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF.format(_LOWER)} ELSE {_LEAF.format("text")} END AS given FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d
), up AS (
  SELECT source, 0 AS lv, place AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM n
  UNION ALL SELECT source, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY source, lv, n, i // 16
), s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM up WHERE n = 1
), top AS (
  SELECT '' AS source, 1000 AS lv, place AS i, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT source, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY source, lv, n, i // 16
), a AS (
  SELECT source, lv, i, {_STEPS} FROM up WHERE n > 1
), b AS (
  SELECT lv, i, {_STEPS} FROM top WHERE n > 1
), steps AS (
  SELECT rid, a.lv, l, r FROM n JOIN a ON n.source IS NOT DISTINCT FROM a.source AND n.place // CAST(pow(16, a.lv) AS BIGINT) = a.i
  UNION ALL SELECT rid, b.lv, l, r FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source JOIN b ON s.place // CAST(pow(16, b.lv - 1000) AS BIGINT) = b.i
), proofs AS (
  SELECT rid, string_agg(l || r, '' ORDER BY lv) AS joined, list(l || ',' || r ORDER BY lv) AS parts FROM steps GROUP BY rid
), f AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(joined, '')) AS proof_sha256,
         list_reduce(list_prepend(given, coalesce(parts, [])), lambda x, y: sha256(string_split(y, ',')[1] || x || string_split(y, ',')[2])) AS folded_root
  FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source LEFT JOIN proofs USING (rid)
)
SELECT *, folded_root = root AS verified FROM f
"""
