"""Repair of the structure of conversations by the cheapest edits, with Spark SQL's higher-order functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import crc32_sql, durable

#: Turns that one fold takes; longer conversations are several chunks, whose results are composed.
CHUNK = 256
#: Chunks that are composed at a time.
FAN = 16
#: Costs of the edits, and of a truncated turn that stays; more than any conversation costs.
REROLE, DELETE, INSERT, STAYS_TRUNCATED, FAR = 1, 2, 5, 5, 1 << 40
#: What a conversation repaired so far ends with: nothing, system, user, assistant. It may end with nothing or assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
TOKEN = "I*[KRD]"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``dropped`` of every row, with nulls of role and text as one blank.

    By crc32 of ``conv_id:turn`` (a null is one blank there) modulo 20: 0 marks the row as dropped, 1 empties its text,
    2 takes ``.!?`` out of it, 3 repeats it, 4 gives it to the user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), copies).drop("_copy")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows in order: ``at`` ascends with the turns of a conversation, ``slot`` changes every CHUNK rows.

    Rows are range-partitioned by conversation and turn, so a conversation of any length is dealt over partitions, and
    written once; then a row's place is fixed.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "conv_id", "turn", "role", "text", "dropped",
        F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.substring("text", 1, 64).alias("head"), F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "head", "digest", "row"]
    placed = durable(slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "row"))
    return placed.withColumn("at", F.monotonically_increasing_id()).withColumn("slot", F.expr(f"at div {CHUNK}"))


def _repeats(placed: DataFrame) -> DataFrame:
    """(conv, slot, repeats): places of the rows whose role and text stand earlier in the conversation.

    Rows are ranked among those of their chunk, then the first of each chunk among the chunks; texts do not move.
    """
    same = ["conv", "role", "digest"]
    live = placed.where("not dropped").select(*same, "slot", "at")
    ranked = live.withColumn("n", F.row_number().over(Window.partitionBy(*same, "slot").orderBy("at")))
    later = ranked.where("n = 1").withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("slot")))
    found = ranked.where("n > 1").unionByName(later.where("n > 1"))
    return found.groupBy("conv", "slot").agg(F.collect_list("at").alias("repeats"))


def _add(path: Column, cost: int | Column, edits: str) -> Column:
    return F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], F.lit(edits)).alias("audit"))


def _inserted(paths: Column) -> Column:
    """The four paths where turns may be inserted first: a user after anything else, an assistant after a user."""
    p = [F.element_at(paths, i + 1) for i in range(4)]
    user = F.least(p[USER], *[_add(p[i], INSERT, "I") for i in (NOTHING, SYSTEM, ASSISTANT)])
    assistant = F.least(p[ASSISTANT], _add(p[USER], INSERT, "I"), *[_add(p[i], 2 * INSERT, "II") for i in (NOTHING, SYSTEM)])
    return F.array(p[NOTHING], p[SYSTEM], user, assistant)


def _edited(paths: Column, turn: Column) -> Column:
    """The four cheapest paths after a turn: it is kept, given to another role, or deleted."""
    p = [F.element_at(paths, i + 1) for i in range(4)]
    stays = F.when(turn["fault"].isin(BLANK, DUPLICATE), FAR).when(turn["fault"] == TRUNCATED, STAYS_TRUNCATED).otherwise(0).cast("long")
    keep = lambda initial: F.when(turn["initial"] == initial, stays).otherwise(F.lit(FAR))
    before_user = F.least(p[NOTHING], p[SYSTEM], p[ASSISTANT])
    return F.array(
        _add(p[NOTHING], DELETE, "D"),
        F.least(_add(p[NOTHING], keep("s"), "K"), _add(p[SYSTEM], DELETE, "D")),
        F.least(_add(before_user, keep("u"), "K"), _add(before_user, stays + REROLE, "R"), _add(p[USER], DELETE, "D")),
        F.least(_add(p[USER], keep("a"), "K"), _add(p[USER], stays + REROLE, "R"), _add(p[ASSISTANT], DELETE, "D")),
    )


def folded(turns: Column, first: Column) -> Column:
    """Four (cost, audit) structs, one for what the turns may end with, where they follow what ``first`` ends with.

    Of equally dear paths the least audit stays. Audits of one cost and end are never beginnings of each other, since
    more insertions would cost more, so what is least stays so whatever follows.
    """
    start = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.struct(F.when(i == first, 0).otherwise(FAR).cast("long").alias("cost"), F.lit("").alias("audit")))
    step = lambda paths, turn: F.element_at(F.transform(F.array(_inserted(paths)), lambda p: _edited(p, turn)), 1)
    return F.aggregate(turns, start, step)


def _ended(paths: Column, tail: list[str] = ()) -> Column:  # type: ignore[assignment]
    """The cheapest of four paths that ends well, after last insertions; further fields of the structs stay."""
    p = [F.element_at(paths, i + 1) for i in range(4)]
    more = lambda path, n: F.struct((path["cost"] + n * INSERT).alias("cost"), F.concat(path["audit"], F.lit("I" * n)).alias("audit"), *[path[t].alias(t) for t in tail])
    return F.least(more(p[NOTHING], 0), more(p[SYSTEM], 2), more(p[USER], 1), more(p[ASSISTANT], 0))


def _next(state: Column) -> Column:
    return F.when(state == USER, ASSISTANT).otherwise(USER)


def _line(role: Column, text: Column, edit: str) -> Column:
    return F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))


def _named(state: Column) -> Column:
    return F.when(state == USER, "user").otherwise("assistant")


def _insertions(state: Column, n: Column) -> Column:
    one = _line(_named(_next(state)), F.lit(""), "I")
    two = _line(_named(_next(_next(state))), F.lit(""), "I")
    return F.slice(F.array(one, two), F.lit(1), n)


def _moved(state: Column, n: Column) -> Column:
    return F.when(n == 0, state).when(n == 1, _next(state)).otherwise(_next(_next(state)))


def repaired(turns: Column, first: Column, audit: Column) -> Column:
    """The turns (role, text, edit) that the edits of ``audit`` make of the turns; insertions at its end come last."""
    edits = F.regexp_extract_all(audit, F.lit(f"({TOKEN})"), F.lit(1))
    steps = F.zip_with(turns, edits, lambda t, e: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["initial"].alias("initial"), e.alias("edit")))
    start = F.struct(first.cast("int").alias("state"), F.expr("cast(array() as array<struct<role:string,text:string,edit:string>>)").alias("lines"))

    def step(done: Column, x: Column) -> Column:
        n = F.length(x["edit"]) - 1
        letter, state = F.substring(x["edit"], -1, 1), _moved(done["state"], n)
        kept = F.when(x["initial"] == "s", SYSTEM).when(x["initial"] == "u", USER).otherwise(ASSISTANT)
        after = F.when(letter == "D", state).when(letter == "K", kept).otherwise(_next(state))
        own = F.when(letter == "K", F.array(_line(x["role"], x["text"], "K"))).when(letter == "R", F.array(_line(_named(_next(state)), x["text"], "R")))
        own = F.coalesce(own, F.expr("cast(array() as array<struct<role:string,text:string,edit:string>>)"))
        return F.struct(after.cast("int").alias("state"), F.concat(done["lines"], _insertions(done["state"], n), own).alias("lines"))

    last = F.length(F.regexp_extract(audit, "(I*)$", 1))
    return F.aggregate(steps, start, step, lambda done: F.concat(done["lines"], _insertions(done["state"], last)))


def _chunks(rows: DataFrame) -> DataFrame:
    """One row for each chunk of a conversation: its place ``k`` of ``parts``, counts, exits for each entry, and turns."""
    placed = _placed(rows)
    live = lambda c: F.when(~F.col("dropped"), c)
    ends = placed.groupBy("conv", "slot").agg(F.max(live(F.struct("at", "initial", "turn"))).alias("end"))
    mine = Window.partitionBy("conv").orderBy("slot")
    ends = ends.select("conv", "slot", F.row_number().over(mine).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("conv")).alias("parts"), F.last("end", True).over(mine.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    turns = F.array_sort(F.collect_list(live(F.struct("at", "turn", "role", "text", "initial", "blank", "cut"))))
    grouped = placed.groupBy("conv", "slot").agg(F.min("conv_id").alias("conv_id"), turns.alias("turns"))
    rows = grouped.join(ends, ["conv", "slot"]).join(_repeats(placed), ["conv", "slot"], "left")

    fault = lambda t: F.when(t["blank"], BLANK).when(F.array_contains("repeats", t["at"]), DUPLICATE).when(t["cut"], TRUNCATED).otherwise(NONE)
    judged = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), t["initial"].alias("initial"), fault(t).alias("fault")))
    rows = rows.withColumn("turns", judged)
    count = lambda kind: F.size(F.filter("turns", lambda t: t["fault"] == kind)).cast("long")
    # initials and turns with the last ones of the chunks before in front
    follows = F.col("before").isNotNull()
    chain = lambda c: F.concat(F.when(follows, F.array(F.col(f"before.{c}"))).otherwise(F.expr(f"slice(transform(turns, t -> t.{c}), 1, 0)")), F.transform("turns", lambda t: t[c]))
    rows = rows.withColumns({"initials": chain("initial"), "numbers": chain("turn")})
    illegal = F.filter("initials", lambda x, i: (i > 0) & ~F.concat(F.get(F.col("initials"), i - 1), x).isin(*LEGAL))
    new = F.filter("numbers", lambda x, i: x.isNotNull() & F.when(i == 0, ~follows).otherwise(~x.eqNullSafe(F.get(F.col("numbers"), i - 1))))
    entries = F.when(F.col("parts") == 1, F.array(F.lit(NOTHING))).otherwise(F.array(*map(F.lit, range(4))))
    return rows.select(
        "conv", "conv_id", "k", "parts", "turns",
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"),
        F.size(illegal).cast("long").alias("illegal"), F.size(new).cast("long").alias("numbers"),
        F.array_min(F.transform("turns", lambda t: t["turn"])).alias("low"), F.array_max(F.transform("turns", lambda t: t["turn"])).alias("high"),
        F.transform(entries, lambda e: folded(F.col("turns"), e)).alias("exits"),
    )


def _composed(long: DataFrame) -> DataFrame:
    """(conv, best: cost, audit, path) of conversations of several chunks; ``path`` is what each chunk ends with.

    FAN neighbouring chunks at a time become one, with its four exits for each of four entries.
    """
    named = F.transform("exits", lambda entry: F.transform(entry, lambda x, i: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"), i.cast("string").alias("path"))))
    level = long.select("conv", (F.col("k") - 1).alias("k"), named.alias("m"))
    most = long.agg(F.max("k")).first()[0]

    def through(entry: Column, m: Column, to: int) -> Column:
        joined = lambda i: (entry[i], m[i][to])
        return F.least(*[F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["path"], b["path"]).alias("path")) for a, b in map(joined, range(4))])

    while most > 1:
        runs = level.groupBy("conv", F.expr(f"k div {FAN}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("run"))
        both = lambda done, x: F.transform(done, lambda entry: F.array(*[through(entry, x["m"], to) for to in range(4)]))
        level = durable(runs.select("conv", "k", F.aggregate(F.slice("run", 2, FAN), F.col("run")[0]["m"], both).alias("m")))
        most = -(-most // FAN)
    return level.select("conv", _ended(F.col("m")[0], ["path"]).alias("best"))


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which follow each other in a sorted stream."""
    conv, state = None, None
    for batch in batches:
        out = []
        for key, line in zip(batch["conv"].to_pylist(), batch["line"].to_pylist(), strict=True):
            if key != conv:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                conv, state = key, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["conv", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], names=["conv", "sha"])


def _written(line: Column) -> Column:
    return F.concat(line["role"], F.lit(":"), line["text"])


def _long_lines(long: DataFrame, best: DataFrame) -> DataFrame:
    """(conv, conv_id, k, lines) of the chunks of long conversations, by the composed path."""
    steps = best.select("conv", F.col("best.audit").alias("audit"), F.posexplode(F.split("best.path", "")).alias("i", "exit"), F.col("best.path").alias("path")).where("exit <> ''")
    steps = steps.select("conv", (F.col("i") + 1).alias("k"), F.col("exit").cast("int").alias("exit"), F.when(F.col("i") == 0, NOTHING).otherwise(F.expr("substring(path, i, 1)").cast("int")).alias("entry"), F.when(F.col("i") == F.length("path") - 1, F.regexp_extract("audit", "(I*)$", 1)).otherwise("").alias("last"))
    chunk = long.join(steps, ["conv", "k"])
    audit = F.concat(F.get(F.get(F.col("exits"), F.col("entry")), F.col("exit"))["audit"], F.col("last"))
    return chunk.select("conv", "conv_id", "k", repaired(F.col("turns"), F.col("entry"), audit).alias("lines"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, place, role, text, edit: the repaired turns in the order of chunk and place.

    ``rows`` are conv_id, turn, role, text (not null) and ``dropped``; see repair_report.
    """
    chunks = durable(_chunks(rows))
    short = chunks.where("parts = 1").select("conv_id", "k", repaired(F.col("turns"), F.lit(NOTHING), _ended(F.col("exits")[0])["audit"]).alias("lines"))
    long = chunks.where("parts > 1")
    if not long.isEmpty():
        short = short.unionByName(_long_lines(long, durable(_composed(long))).drop("conv"))
    return short.select("conv_id", F.col("k").alias("chunk"), F.posexplode("lines").alias("place", "line")).select("conv_id", "chunk", "place", "line.*")


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` have conv_id, turn, role, text (not null) and ``dropped``; dropped rows only name their conversation.
    Turns are read by number (null first), those of one number by role, then text (its first 64 characters, then its
    digest). A turn's first fault counts: blank, duplicate (role and text stood earlier), truncated. Costs are those of
    the cheapest edits that leave nothing or an optional system turn and alternating user and assistant turns; of these
    the ASCII-least audit is taken, and the repaired turns follow from it.

    Turns are folded in chunks of at most CHUNK by ``aggregate`` over sorted structs; a conversation that spans several
    chunks, such as one of very many turns, is folded from each of four beginnings and composed. Only its digest is
    taken in one task, which reads its lines one after another: SHA-256 has no other way.

    A null conv_id is one conversation. Empty texts are blank; a role is known by its first character. A conversation
    without rows has zeros, an empty audit and the digest of the empty text. An empty table gives no rows; other
    columns are ignored.
    """
    whole = _ended(F.col("exits")[0])
    lines = F.transform(repaired(F.col("turns"), F.lit(NOTHING), F.col("best.audit")), _written)
    once = F.col("parts") == 1
    chunks = _chunks(rows).withColumn("best", F.when(once, whole))
    chunks = chunks.withColumn("sha", F.when(once, F.sha2(F.array_join(lines, "\n"), 256)))
    # texts of conversations that are one chunk are not needed any more
    chunks = durable(chunks.withColumns({"turns": F.when(~once, F.col("turns")), "exits": F.when(~once, F.col("exits"))}))
    numbers = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), F.lit(0)).cast("long").alias("gaps")
    facts = ["conv_id", gaps, *numbers]
    out = chunks.where(once).select(*facts, "best.cost", "best.audit", F.col("sha").alias("repaired_sha256"))
    long = chunks.where(~once)
    if long.isEmpty():
        return out
    best = durable(_composed(long))
    sums = long.groupBy("conv").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in [*numbers, "numbers"]], F.min("low").alias("low"), F.max("high").alias("high"))
    lines = _long_lines(long, best).select("conv", "k", F.posexplode("lines").alias("place", "line")).select("conv", "k", "place", _written(F.col("line")).alias("line"))
    digests = lines.repartition("conv").sortWithinPartitions("conv", "k", "place").select("conv", "line").mapInArrow(_whole_texts, "conv string, sha string")
    joined = sums.join(best, "conv").join(digests, "conv", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.unionByName(joined.select(*facts, "best.cost", "best.audit", F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256")))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    return repair_report(damaged(conversations))


def _sql_add(path: str, cost: int | str, edits: str, line: str = "''") -> str:
    return f"{{'c': {path}.c + {cost}, 'a': {path}.a || '{edits}', 't': {path}.t || {line}}}"


_U, _A = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_KEEP, _STAYS = "CASE WHEN ini = '{}' THEN stays ELSE 1099511627776 END", "stays"
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations
), r AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, (VALUES (0), (1)) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substring(text, 1, 64), sha256(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM r
), f AS (
  SELECT *, CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM n
), g AS (
  SELECT *, CASE WHEN fault IN (1, 2) THEN 1099511627776 WHEN fault = 3 THEN 5 ELSE 0 END AS stays, chr(10) || role || ':' || text AS own, ':' || text AS body FROM f
), z AS (
  SELECT {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS start, {{'c': CAST(1099511627776 AS BIGINT), 'a': '', 't': ''}} AS far
), w AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS i, z.start AS e, z.far AS s, z.far AS u, z.far AS a FROM (SELECT DISTINCT conv_id FROM conversations) c, z
  UNION ALL
  SELECT conv_id, i, {_sql_add("e", 2, "D")},
         least({_sql_add("e", _KEEP.format("s"), "K", "own")}, {_sql_add("s", 2, "D")}),
         least({_sql_add("b", _KEEP.format("u"), "K", "own")}, {_sql_add("b", "stays + 1", "R", "chr(10) || 'user' || body")}, {_sql_add("u", 2, "D")}),
         least({_sql_add("u", _KEEP.format("a"), "K", "own")}, {_sql_add("u", "stays + 1", "R", "chr(10) || 'assistant' || body")}, {_sql_add("a", 2, "D")})
  FROM (SELECT g.*, q.e, q.s, q.u, q.a, least(q.e, q.s, q.a) AS b FROM (
    SELECT conv_id, i, e, s, least(u, {", ".join(_sql_add(p, 5, "I", _U) for p in "esa")}) AS u,
           least(a, {_sql_add("u", 5, "I", _A)}, {", ".join(_sql_add(p, 10, "II", f"{_U} || {_A}") for p in "es")}) AS a FROM w
  ) q JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i + 1)
), best AS (
  SELECT conv_id, least(e, {_sql_add("s", 10, "II", f"{_U} || {_A}")}, {_sql_add("u", 5, "I", _A)}, a) AS p
  FROM w QUALIFY i = max(i) OVER (PARTITION BY conv_id)
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, p.c AS cost, p.a AS audit, sha256(substring(p.t, 2)) AS repaired_sha256
FROM best b LEFT JOIN facts x ON b.conv_id IS NOT DISTINCT FROM x.conv_id
"""
