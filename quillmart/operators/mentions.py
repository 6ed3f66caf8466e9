"""Mentions of a dictionary table in texts: all of them, their distance to anchors, the best of each entity."""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions.durable import durable

#: Bytes of aliases that one automaton takes; larger dictionaries are several automata, each over all texts.
PART_BYTES = 2 << 20
_automata: dict[int, object] = {}


def _automaton(words):
    """The automaton of a broadcast list of words, built once in each worker; an earlier one is forgotten."""
    import ahocorasick

    if words.id not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton()
        for word in words.value:
            built.add_word(word, word)
        built.make_automaton()
        _automata[words.id] = built
    return _automata[words.id]


class _Words:
    """A broadcast list of words, known by a number that is the same in all workers."""

    def __init__(self, spark, words: list[str]):
        self.sent = spark.sparkContext.broadcast(words)
        self.id = self.sent._jbroadcast.id()

    @property
    def value(self) -> list[str]:
        return self.sent.value

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}


def _found(batches: Iterator[pa.RecordBatch], words: _Words, edges: bool) -> Iterator[pa.RecordBatch]:
    if not words.value:
        return
    automaton = _automaton(words)
    for batch in batches:
        keys = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
        rows, alias, start, before, after = [], [], [], [], []

        def ready() -> pa.RecordBatch:
            taken = [batch.column(i).take(pa.array(rows, pa.int64())) for i in keys]  # noqa: B023
            sides = {"before": pa.array(before, pa.string()), "after": pa.array(after, pa.string())} if edges else {}  # noqa: B023
            out = pa.RecordBatch.from_arrays([*taken, pa.array(alias, pa.string()), pa.array(start, pa.int32()), *sides.values()], names=[*[batch.schema.names[i] for i in keys], "alias", "start", *sides])  # noqa: B023
            for x in (rows, alias, start, before, after):  # noqa: B023
                x.clear()
            return out

        for row, text in enumerate(batch["_text"].to_pylist()):
            for end, word in automaton.iter(text or ""):
                rows.append(row)
                alias.append(word)
                start.append(end + 1 - len(word))
                if edges:
                    before.append(text[start[-1] - 1] if start[-1] else "")
                    after.append(text[end + 1 : end + 2])
                if len(rows) >= 65_536:
                    yield ready()
        yield ready()


def mentions(texts: DataFrame, keys: list[str], text: Column | str, aliases: DataFrame, edges: bool = False) -> DataFrame:
    """(keys, alias, start) of every place where an alias stands in a text, overlapping ones and those inside others too.

    ``start`` counts characters from 0. ``aliases`` has a column ``alias``; of any number of rows the distinct ones
    that are not empty make automata of PART_BYTES each, which are all that the driver and a worker hold. A text is
    read once for each automaton, in time that grows with its length and its mentions, not with the dictionary. Null
    texts have no mention. With ``edges`` come the characters ``before`` and ``after`` it, empty at the text's ends.
    """
    rows = texts.select(*keys, F.col(text).alias("_text") if isinstance(text, str) else text.alias("_text"))
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "alias string", "start int", *(["before string", "after string"] if edges else [])])
    return functools.reduce(DataFrame.unionByName, _over_parts(rows, aliases, functools.partial(_found, edges=edges), schema))


def _over_parts(rows: DataFrame, aliases: DataFrame, task: Callable, schema: str) -> list[DataFrame]:
    """The rows read by ``task`` with each part of the aliases, PART_BYTES of them at a time."""
    spark = rows.sparkSession
    names = durable(aliases.select("alias").where("alias <> ''").distinct())
    total = names.agg(F.coalesce(F.sum(F.octet_length("alias")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES))
    out = []
    for part in range(parts):
        mine = names.where(F.pmod(F.xxhash64(F.lit(3), "alias"), F.lit(parts)) == part)
        out.append(rows.mapInArrow(functools.partial(task, words=_Words(spark, sorted(r[0] for r in mine.collect()))), schema))
    return out


def _places(text: str, word: str) -> list[int]:
    """The places of a word in a text, one after another without overlap."""
    found, at = [], text.find(word) if word else -1
    while at >= 0:
        found.append(at)
        at = text.find(word, at + len(word))
    return found


def _best_places(text: str, anchor: str | None, automaton, tiers: list[int]) -> dict[str, tuple[int, int, int | None]]:
    """alias: (tier, start, distance) of the mention of each alias that is in the least tier, then first."""
    spots, best = _places(text, anchor or ""), {}
    for end, word in automaton.iter(text):
        seen = best.get(word)
        if seen is not None and (not spots or seen[0] == 0):
            continue
        start, distance, tier = end + 1 - len(word), None, len(tiers)
        if spots:
            i = bisect_right(spots, start)
            distance = start - spots[i - 1] if i else spots[0] - start
            if i and i < len(spots):
                distance = min(distance, spots[i] - start)
            tier = bisect_left(tiers, distance)
        if seen is None or tier < seen[0]:
            best[word] = (tier, start, distance)
    return best


def first_places(text: str, anchor: str | None, automaton, tiers: list[int]) -> dict[str, tuple[int, int]]:
    """alias: (tier, start) of the mention of each alias that is in the least tier, then first, without its distance."""
    ends, spots = list(automaton.iter(text)), _places(text, anchor or "")
    far = len(tiers)
    # the tier of each place of the text, nearer ones over farther ones
    near = bytearray([far]) * len(text)
    for tier in range(far - 1, -1, -1):
        most = tiers[tier]
        for spot in spots:
            low, high = max(0, spot - most), min(len(text), spot + most + 1)
            near[low:high] = bytes([tier]) * (high - low)
    best = {word: (far, end + 1 - len(word)) for end, word in reversed(ends)}
    if spots:
        for end, word in ends:
            start = end + 1 - len(word)
            tier = near[start]
            if tier < best[word][0]:
                best[word] = (tier, start)
    return best


def _placed(batches: Iterator[pa.RecordBatch], words: _Words, tiers: list[int]) -> Iterator[pa.RecordBatch]:
    if not words.value:
        return
    automaton = _automaton(words)
    for batch in batches:
        keys = [i for i, name in enumerate(batch.schema.names) if name not in ("_text", "_anchor")]
        rows, alias, start, distance = [], [], [], []

        def ready() -> pa.RecordBatch:
            taken = [batch.column(i).take(pa.array(rows, pa.int64())) for i in keys]  # noqa: B023
            out = pa.RecordBatch.from_arrays([*taken, pa.array(alias, pa.string()), pa.array(start, pa.int32()), pa.array(distance, pa.int32())], names=[*[batch.schema.names[i] for i in keys], "alias", "start", "distance"])  # noqa: B023
            for x in (rows, alias, start, distance):  # noqa: B023
                x.clear()
            return out

        for row, (text, anchor, how) in enumerate(zip(batch["_text"].to_pylist(), batch["_anchor"].to_pylist(), batch["how"].to_pylist(), strict=True)):
            if how == "whole":
                best = {text: (0, 0, None)} if text and text in automaton else {}
            else:
                best = _best_places(text or "", anchor, automaton, tiers)
            if how == "longest" and best:
                word = min(best, key=lambda w: (-len(w), best[w][1], w))  # noqa: B023
                best = {word: best[word]}
            for word, (_, at, far) in best.items():
                rows.append(row)
                alias.append(word)
                start.append(at)
                distance.append(far)
            if len(rows) >= 65_536:
                yield ready()
        yield ready()


def placed_mentions(texts: DataFrame, keys: list[str], text: str, anchor: str, how: str, aliases: DataFrame, tiers: list[int]) -> DataFrame:
    """(keys, how, alias, start, distance): the mention of each alias in each text that stands nearest to the anchor.

    Distances count by ``tiers`` (``<=`` each, ascending); of equal ones the first mention is taken. They are measured
    to the nearest of all places of the text's own anchor, and null without one. ``how`` is a column: ``near`` as said,
    ``longest`` for the longest alias of the text alone (then the first), ``whole`` for texts that are an alias. All is
    found in the row of the text, so only one row an alias leaves it. ``keys`` are unique by text for ``longest``.
    """
    rows = texts.select(*keys, F.col(how).alias("how"), F.col(text).alias("_text"), F.when(F.col(how) == "near", F.col(anchor)).alias("_anchor"))
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "how string", "alias string", "start int", "distance int"])
    parts = _over_parts(rows, aliases, functools.partial(_placed, tiers=tiers), schema)
    found = functools.reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return found
    # the longest of each part meet
    longest = found.where("how = 'longest'").groupBy(*keys, "how").agg(F.min(F.struct((-F.char_length("alias")).alias("l"), "start", "alias", "distance")).alias("m"))
    return found.where("how <> 'longest'").unionByName(longest.select(*keys, "how", "m.alias", "m.start", "m.distance"))


def _judged(batches: Iterator[pa.RecordBatch], words: _Words, judge: Callable, given: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(words) if words.value else None
    for batch in batches:
        keys = [i for i, name in enumerate(batch.schema.names) if name not in given]
        rows, out = [], []
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for row, values in enumerate(zip(*[piece[c].to_pylist() for c in given], strict=True), at):
                found = judge(automaton, *values)
                rows += [row] * len(found)
                out += found
        taken = [batch.column(i).take(pa.array(rows, pa.int64())) for i in keys]
        made = [pa.array([x[i] for x in out], pa.int64()) for i in range(len(columns))]
        yield pa.RecordBatch.from_arrays([*taken, *made], names=[*[batch.schema.names[i] for i in keys], *columns])


def judged_rows(rows: DataFrame, keys: list[str], given: list[str], aliases: list[str], judge: Callable, columns: list[str]) -> DataFrame:
    """(keys, columns) that ``judge`` finds in each row: whole numbers, as a list of tuples, out of the automaton and ``given``.

    For aliases of one automaton, of PART_BYTES at most; without any, ``judge`` gets None for it. A row is judged where
    it is, and only what it is judged to give leaves it.
    """
    both = [F.col(c).alias(f"_given{i}") for i, c in enumerate(given)]
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"{c} long" for c in columns]])
    words = _Words(rows.sparkSession, sorted({a for a in aliases if a}))
    task = functools.partial(_judged, words=words, judge=judge, given=[f"_given{i}" for i in range(len(given))], columns=columns)
    return rows.select(*keys, *both).mapInArrow(task, schema)


def stands_alone() -> Column:
    """Whether no letter, digit or underscore touches a mention found with its edges."""
    word = r"[\p{L}\p{N}_]"
    return ~F.col("before").rlike(word) & ~F.col("after").rlike(word)


def best_of_entities(found: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first mention of each entity in each text by ``order``, by partial minima: no sort, no hot group."""
    ranks = [c.alias(f"o{i}") for i, c in enumerate(order)]
    best = F.min(F.struct(*ranks, *columns)).alias("_best")
    return found.groupBy(*keys, "entity").agg(best).select(*keys, "entity", *[F.col(f"_best.{c}") for c in columns])


def occurrences(texts: DataFrame, keys: list[str], text: str, word: str) -> DataFrame:
    """(keys, start) of the places of each text's own word, one after another without overlap."""
    rows = texts.where((F.col(word) != "") & F.contains(text, word))
    # the word as it is: a quotation ends where the word holds its end mark, and begins anew
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = rows.select(*keys, F.char_length(word).alias("_l"), F.posexplode(F.split(F.col(text), quoted)).alias("_i", "_part"))
    so_far = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.select(*keys, "_i", (F.sum(F.char_length("_part") + F.col("_l")).over(so_far) - F.col("_l")).cast("int").alias("start"), F.max("_i").over(Window.partitionBy(*keys)).alias("_last"))
    return ends.where("_i < _last").select(*keys, "start")


def nearest_anchor(found: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """The mentions with ``distance`` to the nearest of all anchors of their text; null where it has none.

    Mentions and anchors are read in order of place; the last anchor behind and the first ahead are carried along.
    """
    blank = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c not in (*keys, "start")]
    both = found.withColumn("_at", F.lit(None).cast("int")).unionByName(anchors.select(*keys, "start", *blank, F.col("start").alias("_at")))
    line = Window.partitionBy(*keys).orderBy("start")
    behind = F.last("_at", True).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("_at", True).over(line.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    marked = both.withColumns({"_behind": behind, "_ahead": ahead}).where("_at IS NULL")
    return marked.withColumn("distance", F.least(F.col("start") - F.col("_behind"), F.col("_ahead") - F.col("start"))).drop("_at", "_behind", "_ahead")
