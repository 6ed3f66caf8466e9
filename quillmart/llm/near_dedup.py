"""MinHash near-dedup by an inverted join on signature coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import durable, free_names
from quillmart.operators.components import connected_components
from quillmart.operators.hot import hot_keys, join_unique

SHINGLE_WORDS = 5
#: Signature length, and matching coordinates that a pair needs to be compared in full. A pair at similarity 0.75
#: matches in 24 of 32 coordinates on average; fewer than 12 has a probability of about 3 in a million.
COORDINATES, MATCHES = 32, 12
#: Pivots with which every posting list is compared before what is left is compared pairwise.
PIVOTS = 3
#: Members of a hot posting list that meet as many others in one cell of its grid.
CELL_ROWS = 1024
#: A text with a word; others have no shingle.
HAS_WORD = r"[^\x20\x09-\x0D]"
#: 64-bit words of the parity table that bounds the difference of two sets.
PARITY_WORDS = 32
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.RandomState(1)
_MULTIPLY = (_rng.randint(0, 2**62, COORDINATES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.randint(0, 2**62, COORDINATES).astype(np.uint64)


#: Bytes of words that are hashed at a time, and 64-bit numbers for the values of a byte (A-Z as a-z) and its place in a word.
HASHED_BYTES = 1 << 20
_VALUES = _rng.randint(0, 2**62, 256).astype(np.uint64) * np.uint64(4) + _rng.randint(0, 4, 256).astype(np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _places(n: int) -> np.ndarray:
    """An odd 64-bit number for each of the first n places of a word."""
    x = np.arange(1, n + 1, dtype=np.uint64) * _MIX1
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


_PLACES = _places(256)


def _word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word in order: its bytes' numbers times those of their places, summed up."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + HASHED_BYTES)))
        long = sizes[first:last]
        begin = np.cumsum(long) - long
        place = np.arange(long.sum()) - np.repeat(begin, long)
        part = slice(starts[first], starts[last - 1] + long[-1])
        bytes_ = data[part][inside[1:-1][part]]
        most = int(long.max())
        numbers = _PLACES if most <= len(_PLACES) else _places(most)
        out[first:last] = np.add.reduceat(_VALUES[bytes_] * numbers[place], begin) + long.astype(np.uint64) * _MIX1
        first = last
    out ^= out >> np.uint64(32)
    out *= _MIX2
    return out ^ (out >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of fewer words the whole sequence is one.

    A-Z counts as a-z and words end at ASCII white space, both in the UTF-8 bytes, where no other character holds those
    bytes. No text or no word gives an empty set.
    """
    h = _word_hashes(text or b"")
    if not len(h):
        return h
    width = min(SHINGLE_WORDS, len(h))
    n = len(h) - width + 1
    s = np.full(n, np.uint64(width))
    for k in range(width):
        s = s * _MIX1 + h[k : k + n]
        s ^= s >> np.uint64(29)
    s *= _MIX2
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    """The texts as the UTF-8 bytes that they are."""
    texts = batch["text"]
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def signature(s: np.ndarray) -> bytes:
    """Minima of COORDINATES multiply-add hashes as 32-bit numbers; empty for an empty set."""
    if not len(s):
        return b""
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (_MULTIPLY[:, None] * s[at : at + 4096] + _ADD[:, None]).min(1))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def parities(s: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of shingles falls on i of 64 * PARITY_WORDS places.

    Two such tables differ in at most as many bits as their sets differ in shingles.
    """
    odd = np.bincount((s % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        sets = [shingles(t) for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["h1"], batch["h2"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([signature(s) for s in sets], pa.binary())],
            names=["doc_id", "h1", "h2", "n_shingles", "set_key", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        sets = [shingles(t) for t in _texts(batch)]
        right = pa.array([_set_key(s) == k for s, k in zip(sets, batch["set_key"].to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch["cls"], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))],
            names=["cls", "shingle_set", "bits"],
        ).filter(right)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch["shingle_set"]]
        ids = np.repeat(batch["cls"].to_numpy(zero_copy_only=False), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["cls", "shingle"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, token) for every coordinate-value pair."""
    names = np.arange(COORDINATES, dtype=np.int64) << np.int64(32)
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u4").reshape(-1, COORDINATES)
        ids = batch["cls"].to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, COORDINATES)), pa.array((sigs.astype(np.int64) | names).ravel())], names=["cls", "token"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parity tables allow a link and whose signatures match in MATCHES coordinates or more.

    A link needs a symmetric difference of at most a seventh of the sizes' sum n; the tables differ in no more bits.
    """
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
        x, y = (batch[c].flatten().to_numpy().view(np.uint64).reshape(-1, PARITY_WORDS) for c in ("bits_a", "bits_b"))
        apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(((a == b).sum(1) >= MATCHES) & (7 * apart <= batch["n"].to_numpy())))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= 75 * union over the full sets."""
    for batch in _small(batches):
        keep = []
        for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * common >= 75 * (len(s) + len(t) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _postings(classes: DataFrame) -> DataFrame:
    """(token, cls) of the prefix of each signature.

    Two signatures that match in MATCHES coordinates share one of the first COORDINATES - MATCHES + 1 in any common
    order. The order is rarest first, so a value that thousands of documents share, because they hold the same line
    or passage, is posted only for documents that consist of such values by more than a third. Values with one owner
    take the first places and need no posting.
    """
    tokens = durable(classes.select("cls", "sig").mapInArrow(_tokens, "cls long, token long"))
    owners = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    shared = tokens.join(owners, "token")
    mine = Window.partitionBy("cls")
    ranked = shared.select("cls", "token", F.row_number().over(mine.orderBy("owners", "token")).alias("i"), F.count(F.lit(1)).over(mine).alias("shared"))
    prefix = ranked.where(F.col("i") + (COORDINATES - F.col("shared")) <= COORDINATES - MATCHES + 1)
    return durable(prefix.select("token", "cls"))


def _may_link(a: str, b: str) -> Column:
    """Whether classes can reach the similarity, by their sizes n and shared shingles s: at most min(s, s') are common."""
    col = lambda side, c: F.col(side.format(c))
    size, common = col(a, "n") + col(b, "n"), F.least(col(a, "s"), col(b, "s"))
    return 100 * common >= 75 * (size - common)


#: Pairs of a cell whose parity tables are compared at a time, some 16 MB for each side.
COMPARED = 1 << 16


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n: sum of sizes) of the pairs of each cell that may be links of two components, out of rows in order of cells.

    A cell's left members lie outside the largest component of their list, its right ones are all of a part of the list.
    Pairs within a component are left out, and those that sizes, shared shingles or parity tables rule out: a link needs
    a symmetric difference of at most a seventh of the sizes' sum, and the tables differ in no more bits.
    """
    names = ["token", "row", "column", "left", "cls", "label", "n", "s", "most"]

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        side = np.flatnonzero(rows["left"]), np.flatnonzero(~rows["left"])
        cls, label, n, s = ([rows[c][x] for x in side] for c in ("cls", "label", "n", "s"))
        for at in range(0, len(side[0]), strip := max(1, (1 << 20) // max(1, len(side[1])))):
            own = slice(at, at + strip)
            size, common = n[0][own, None] + n[1], np.minimum(s[0][own, None], s[1])
            # between two members outside the largest component each pair is looked at once
            once = (label[1] == rows["most"][0]) | (cls[0][own, None] < cls[1])
            i, j = np.nonzero((label[0][own, None] != label[1]) & once & (100 * common >= 75 * (size - common)))
            for k in range(0, len(i), COMPARED):
                p, q = i[k : k + COMPARED] + at, j[k : k + COMPARED]
                apart = np.bitwise_count(rows["bits"][side[0][p]] ^ rows["bits"][side[1][q]]).sum(1, dtype=np.int64)
                may = 7 * apart <= n[0][p] + n[1][q]
                a, b = cls[0][p[may]], cls[1][q[may]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), n[0][p[may]] + n[1][q[may]])], names=["a", "b", "n"])

    kept = None
    for batch in batches:
        rows = {c: batch[c].to_numpy(zero_copy_only=False) for c in names}
        rows["bits"] = batch["bits"].flatten().to_numpy().view(np.uint64).reshape(-1, PARITY_WORDS)
        if kept:
            rows = {c: np.concatenate([kept[c], x]) for c, x in rows.items()}
        new = np.zeros(max(0, len(rows["token"]) - 1), bool)
        for c in names[:3]:
            new |= rows[c][1:] != rows[c][:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield from pairs({c: x[a:b] for c, x in rows.items()})
        kept = {c: x[starts[-1] :] for c, x in rows.items()}
    if kept and len(kept["token"]):
        yield from pairs(kept)


def _confirm(pairs: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, n: sum of sizes) that are links: by parity table, signature and then full sets."""
    side = lambda c: facts.select(F.col("cls").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("sig").alias(f"sig_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n", "bits_a", "bits_b", "sig_a", "sig_b")
    near = durable(met.mapInArrow(_alike, "a long, b long"))
    with_a = near.join(sets.select(F.col("cls").alias("a"), F.col("shingle_set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("cls").alias("b"), F.col("shingle_set").alias("set_b")), "b")
    return durable(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long"))


def _pair(a: str, b: str, n: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), n.alias("n")]


def _grid(rows: DataFrame, hot: DataFrame | None, own: str, other: str, cls: str) -> DataFrame:
    """Rows of posting lists dealt over the cells of a square grid: one row or column of cells for each member."""
    if hot is None:
        return rows.withColumn(own, F.lit(0)).withColumn(other, F.lit(0))
    side = F.ceil(F.coalesce(F.col("rows_of_key"), F.lit(1)) / CELL_ROWS).cast("int")
    dealt = rows.join(F.broadcast(hot), "token", "left").withColumn("_side", side)
    return dealt.withColumn(own, F.pmod(F.xxhash64(F.lit(41), cls), F.col("_side")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_side") - 1))).drop("_side", "rows_of_key")


def _same_id_links(linkable: DataFrame, classes: DataFrame, hot_sets: DataFrame | None) -> DataFrame | None:
    """(a, b) between the classes of an id that stands for several texts, each to the id's least set; None if none is."""
    spread = linkable.groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).where("first <> last")
    spread = durable(spread.select("doc_id", "first"))
    if spread.isEmpty():
        return None
    several = join_unique(linkable.select("doc_id", "set_key"), spread, "doc_id", hot_keys(linkable, "doc_id"))
    keys = durable(several.where("set_key <> first").select("set_key", "first").distinct())
    named = classes.select("set_key", "cls")
    one = join_unique(keys, named.withColumnRenamed("cls", "a"), "set_key", hot_sets).select("a", F.col("first").alias("set_key"))
    return join_unique(one, named.withColumnRenamed("cls", "b"), "set_key", hot_keys(one, "set_key")).select("a", "b")


def _judged(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h1, h2, n_shingles, best) with a set and an id, and the others (doc_id, h1, h2, n_shingles).

    ``best`` is the least (doc_id, h1, h2) of the row's component, where h1 and h2 are hashes of the text.
    """
    rows = documents.select("doc_id", *_text_hashes(F.col("text")), "text")
    signed = durable(rows.mapInArrow(_signed, "doc_id long, h1 long, h2 long, n_shingles long, set_key binary, sig binary"))
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    hot_sets = hot_keys(linkable, "set_key")
    # a class is a set of shingles, numbered by its place in the checkpoint, which does not change any more
    classes = linkable.groupBy("set_key").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("best"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    classes = durable(classes).withColumn("cls", F.monotonically_increasing_id())
    postings = _postings(classes)
    members = postings.select("cls").distinct()
    hot_tokens = hot_keys(postings, "token")

    # one whole text for each class: rows are told apart by id and hashes of the text, repeated rows are one
    firsts = rows.where("doc_id is not null").groupBy("doc_id", "h1", "h2").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    wanted = classes.join(members, "cls", "left_semi").select("cls", "set_key", "best.*")
    texts = firsts.join(wanted, ["doc_id", "h1", "h2"]).select("cls", "set_key", "text")
    sets = durable(texts.mapInArrow(_sets, "cls long, shingle_set binary, bits array<long>"))

    # shingles that no other posted class has cannot be in an intersection: s bounds it for every partner
    shared = sets.mapInArrow(_exploded, "cls long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("owners"), F.min("cls").alias("cls"))
    lone = shared.where("owners = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("lone"))
    posted = classes.select("cls", "n", "sig").join(sets.select("cls", "bits"), "cls").join(lone, "cls", "left").withColumn("s", F.col("n") - F.coalesce("lone", F.lit(0)))
    facts = durable(posted.where("100 * s >= 75 * n").select("cls", "n", "s", "bits", "sig"))
    members = postings.join(facts.select("cls", "n", "s"), "cls")
    order = [F.struct(F.xxhash64(F.lit(turn), "token", "cls").alias("h"), "cls", "n", "s") for turn in range(PIVOTS)]
    pivots = members.groupBy("token").agg(F.array_distinct(F.array(*[F.min(x) for x in order])).alias("pivots"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "pivots")
    met = join_unique(members, pivots, "token", hot_tokens).select("cls", "n", "s", F.explode("pivots").alias("p"))
    met = met.where((F.col("cls") != F.col("p.cls")) & _may_link("{}", "p.{}"))
    links = _confirm(met.select(*_pair("cls", "p.cls", F.col("n") + F.col("p.n"))).distinct(), facts, sets)

    # members outside the largest component of their list meet all of other components
    known = connected_components(links, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("known"))
    at = durable(postings.join(facts.select("cls", "n", "s").join(known, "cls", "left").select("cls", F.coalesce("known", "cls").alias("label"), "n", "s"), "cls"))
    parts = at.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", F.col("m.label").alias("most"))
    among = join_unique(at, largest, "token", hot_tokens).join(facts.select("cls", "bits"), "cls")
    among = durable(among.select("cls", "label", "n", "s", "bits", "token", "most"))
    left = _grid(among.where("label <> most"), hot_tokens, "row", "column", "cls").withColumn("left", F.lit(True))
    right = _grid(among, hot_tokens, "column", "row", "cls").withColumn("left", F.lit(False))
    # a number of tasks that stays: few bytes make many pairs
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = left.unionByName(right).repartition(tasks, "token", "row", "column").sortWithinPartitions("token", "row", "column")
    met = cells.mapInArrow(_met, "a long, b long, n long")
    links = links.unionByName(_confirm(met.distinct(), facts, sets))

    same = _same_id_links(linkable, classes, hot_sets)
    joined = durable(connected_components(links if same is None else links.unionByName(same), "a", "b"))
    named = durable(joined.withColumnRenamed("node", "cls").join(classes.select("cls", "best"), "cls"))
    best = named.groupBy("component").agg(F.min("best").alias("least"))
    moved = join_unique(named.select("cls", "component"), best, "component", hot_keys(named, "component")).select("cls", "least")
    found = durable(classes.select("cls", "set_key", "best").join(moved, "cls", "left").select("set_key", F.coalesce("least", "best").alias("best")))
    out = join_unique(linkable.select("doc_id", "h1", "h2", "n_shingles", "set_key"), found, "set_key", hot_sets).drop("set_key")
    return out, signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "h1", "h2", "n_shingles")


def _text_hashes(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(3), whole).alias("h1"), F.crc32(whole).alias("h2")]


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets are one class, so copies cost one row each. Every class posts the prefix of its
    signature; classes that meet in a posting list are compared by their signatures and, from MATCHES on, by their
    full sets. Shingles that no other posted class holds bound the intersection beforehand, which takes out classes
    and pairs that cannot link, as do tables of parities. A large list is not turned into all its pairs: its members
    are first compared with PIVOTS pivots, and links join components. Then the members outside the largest component of
    their list are compared with all members of other components, so no link that could join two components is lost. A token that many classes
    post is joined where its rows are, and in the last step its list is dealt over a grid of cells.

    Empty and null texts have no shingles, are linked with nothing and are kept. Rows with a null doc_id are their
    own component (null) and are kept. Rows that repeat a doc_id are one document: what one of them is linked with, the
    others are. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    linked, others = _judged(documents)
    out = linked.select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"))
    out = out.unionByName(others.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns: one row of each component of near copies.

    Where an id repeats, one row of it stays at most. Rows without an id and rows without a word are in no component
    and all stay.
    """
    id_, h1, h2 = free_names(documents, "_near_id", "_near_h1", "_near_h2")
    linked, _ = _judged(documents)
    best = linked.select("best.*").distinct().select(F.col("doc_id").alias(id_), F.col("h1").alias(h1), F.col("h2").alias(h2))
    linkable = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    a, b = _text_hashes(F.col("text"))
    rows = documents.where(linkable).withColumns({id_: F.col("doc_id"), h1: a, h2: b})
    once = rows.dropDuplicates([id_, h1, h2]).join(best, [id_, h1, h2], "left_semi").select(*documents.columns)
    return once.unionByName(documents.where(~linkable))


OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT rid, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t
), g AS (
  SELECT rid, n, pos, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)
), l AS (
  SELECT rid, list_sort(list(DISTINCT shingle)) AS sets FROM g WHERE pos <= greatest(1, n - 4) GROUP BY rid
), d AS MATERIALIZED (
  SELECT doc_id, coalesce(sets, []) AS sets FROM t LEFT JOIN l USING (rid)
), c AS (
  SELECT sets, row_number() OVER () AS cls, len(sets) AS n FROM (SELECT DISTINCT sets FROM d WHERE doc_id IS NOT NULL AND len(sets) > 0)
), s AS (
  SELECT cls, n, unnest(sets) AS shingle FROM c
), p AS (
  SELECT a.cls AS x, b.cls AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.cls < b.cls GROUP BY a.cls, a.n, b.cls, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), m AS MATERIALIZED (
  SELECT DISTINCT doc_id, cls FROM d JOIN c ON d.sets = c.sets WHERE doc_id IS NOT NULL
), e AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS i, b.doc_id AS j FROM m a JOIN m b USING (cls)
  UNION SELECT a.doc_id, b.doc_id FROM p JOIN m a ON a.cls = x JOIN m b ON b.cls = y
  UNION SELECT b.doc_id, a.doc_id FROM p JOIN m a ON a.cls = x JOIN m b ON b.cls = y
), r AS (
  SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i
), k AS (
  SELECT i, min(j) AS component_id FROM r GROUP BY i
)
SELECT d.doc_id, CAST(len(sets) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept FROM d LEFT JOIN k ON d.doc_id = k.i
"""
