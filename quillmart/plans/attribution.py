"""Mentions of a dictionary table in documents, and the entity that the evidence of a document speaks for."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.functions.durable import durable
from quillmart.operators import mentions as M
from quillmart.plans.registry import query
from quillmart.sources.files import table

# Fixed values, in thousandths: confidence and bonus of a match, weights of evidence, bonuses for standing near the
# subject (characters, points), points for each letter beyond three and their most, the least score that needs no review.
MATCHES = {"normalized": (990, 140), "full_alias": (960, 80), "short_alias": (550, -280)}
SHORT_FULL_ALIAS, FULL_LETTERS = 900, 4
WEIGHTS = {
    "local_text": 340,
    "previous_text": 240,
    "article_title": 140,
    "article_description": 90,
    "full_text": 40,
    "product_name_brand": 500,
    "raw_candidate": 20,
    "industry_reresolve": 180,
    "company_candidates": 0,
}
NEAR = [(40, 240), (120, 160), (240, 80)]
LETTER_POINTS, MOST_LETTER_POINTS, FREE_LETTERS = 10, 80, 3
#: Base points of evidence that is a name instead of a text.
BASES = {"product_name_brand": 960, "raw_candidate": 640, "industry_reresolve": 860, "company_candidates": 580}
LEAST_SCORE, MOST_CONFIDENCE, NAME_CONFIDENCE = 620, 990, 900
BASIS = {"previous_text": "previous_sentence", "article_title": "title"}


def dictionary(spark, d) -> DataFrame:
    """entity, alias, kind (of the entity), match_type: each word of five letters or more of a benchmark item.

    A word of several items is a short alias of each; an item's longest word of its own is its name, others are full
    aliases. An item is long from 200 characters on.
    """
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("entity"), F.lower("text").alias("text"))
    words = items.select("entity", F.when(F.char_length("text") >= 200, "long").otherwise("short").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), 1))).alias("alias"))
    owners = words.groupBy("alias").agg(F.count(F.lit(1)).alias("owners"))
    marked = words.join(owners, "alias")
    own = Window.partitionBy("entity").orderBy(F.col("owners") > 1, F.desc(F.char_length("alias")), "alias")
    kinds = F.when(F.col("owners") > 1, "short_alias").when(F.row_number().over(own) == 1, "normalized").otherwise("full_alias")
    return marked.select("entity", "alias", "kind", kinds.alias("match_type"))


_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \n]+|\n+'), lambda x: trim(x)), lambda x: x <> '')"
_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
DICTIONARY_SQL = """
i AS (SELECT item_id AS entity, lower(text) AS text FROM benchmark),
w0 AS (SELECT entity, CASE WHEN length(text) >= 200 THEN 'long' ELSE 'short' END AS kind, unnest(list_distinct(regexp_extract_all(text, '([a-z]{5,})', 1))) AS alias FROM i),
w1 AS (SELECT *, count(*) OVER (PARTITION BY alias) AS owners FROM w0),
dic AS MATERIALIZED (SELECT entity, alias, kind, CASE WHEN owners > 1 THEN 'short_alias' WHEN row_number() OVER (PARTITION BY entity ORDER BY owners > 1, length(alias) DESC, alias) = 1 THEN 'normalized' ELSE 'full_alias' END AS match_type FROM w1)"""


def _mentions_sql(texts: str, name: str) -> str:
    """All places (from 0) of all aliases in the column k of a table of texts: by their first five letters, then whole."""
    leads = ", ".join(f"lead(c, {i}) OVER o" for i in range(1, 5))
    return f"""
{name}_c AS (SELECT doc_id, source, unnest(string_split(k, '')) AS c, generate_subscripts(string_split(k, ''), 1) AS p FROM {texts} WHERE length(k) >= 5),
{name}_g AS (SELECT doc_id, source, p, concat_ws('', c, {leads}) AS g FROM {name}_c WINDOW o AS (PARTITION BY doc_id, source ORDER BY p)),
{name} AS MATERIALIZED (SELECT g.doc_id, g.source, alias, CAST(p - 1 AS INTEGER) AS start FROM {name}_g g JOIN (SELECT DISTINCT alias FROM dic) a ON g = left(alias, 5) JOIN {texts} t ON t.doc_id = g.doc_id AND t.source = g.source WHERE substring(k, p, length(alias)) = alias)"""


@query(f"""
WITH {DICTIONARY_SQL},
t AS (SELECT doc_id, 'full_text' AS source, {_KEY.format("coalesce(text, '')")} AS k FROM documents),
{_mentions_sql("t", "m")}
SELECT doc_id, entity, alias, start, match_type FROM m JOIN dic USING (alias)""")
def alias_mentions(spark, d):
    """Every mention of every alias in the squeezed text of a document, one row for each entity that it may stand for."""
    known = dictionary(spark, d)
    docs = table(spark, d, "documents").select("doc_id", X.search_key(F.coalesce("text", F.lit(""))).alias("k"))
    return M.mentions(docs, ["doc_id"], "k", known).join(known.drop("kind"), "alias").select("doc_id", "entity", "alias", "start", "match_type")


#: Order of the mentions of one entity: kind of match, longer alias, earlier place, alias.
_RANK = "CASE match_type WHEN 'normalized' THEN 0 WHEN 'full_alias' THEN 1 ELSE 4 END"


@query(f"""
WITH {DICTIONARY_SQL},
t AS (SELECT doc_id, 'full_text' AS source, {_KEY.format("coalesce(text, '')")} AS k FROM documents),
{_mentions_sql("t", "m")}
SELECT doc_id, entity, alias, start, match_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY {_RANK}, length(alias) DESC, start, alias) AS r FROM m JOIN dic USING (alias)) WHERE r = 1""")
def best_alias_mention(spark, d):
    order = [F.expr(_RANK), -F.char_length("alias"), F.col("start"), F.col("alias")]
    return M.best_of_entities(alias_mentions(spark, d), ["doc_id"], order, ["alias", "start", "match_type"])


def _candidates(k: Column) -> Column:
    """The distinct keys of the words of a sentence, parted by blanks."""
    return F.array_join(F.array_distinct(F.transform(F.split(k, " "), X.search_key)), " ")


def evidence(spark, d) -> tuple[DataFrame, DataFrame]:
    """(doc_id, expected, anchor, raw) of every document, and its evidence: a list of (source, k), squeezed.

    With the evidence come expected, anchor, letters (characters), bars and later, whether a later sentence has the subject.

    The title is the first sentence and the description the second. The subject, anchor of the rest, is the title's
    longest word; the local text is the first later sentence with it, and the previous text the one before that. The
    raw candidate is the title's first word, company candidates are the words of the last sentence. Documents of 2,000
    characters or more should belong to long items, those below 500 to short ones.
    """
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", X.sentences(F.col("text")).alias("s"))
    # sentences hold no line feed, so all of them are squeezed at once
    rows = rows.withColumn("squeezed", F.regexp_replace(F.lower(F.array_join("s", "\n")), r"[^\p{L}\p{N}\n]+", ""))
    rows = rows.withColumn("keys", F.split("squeezed", "\n")).withColumn("words", F.filter(F.transform(F.split(F.get("s", F.lit(0)), " "), X.search_key), lambda w: w != ""))
    longest = F.array_min(F.transform("words", lambda w: F.struct((-F.char_length(w)).alias("l"), w.alias("w"))))["w"]
    rows = rows.withColumn("anchor", F.coalesce(longest, F.lit(""))).withColumn("raw", F.coalesce(F.get("words", F.lit(0)), F.lit("")))
    # positions from 1 of later sentences with the subject
    later = F.array_min(F.filter(F.transform("keys", lambda k, i: F.when((i > 0) & (F.col("anchor") != "") & F.contains(k, F.col("anchor")), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("local", later)
    size = F.char_length("text")
    expected = F.when(size >= 2000, "long").when(size < 500, "short").alias("expected")
    known = rows.select("doc_id", expected, "anchor", "raw")
    part = lambda source, k: F.struct(F.lit(source).alias("source"), k.alias("k"))
    texts = F.array(
        part("local_text", F.get("keys", F.col("local"))),
        part("previous_text", F.get("keys", F.col("local") - 1)),
        part("article_title", F.get("keys", F.lit(0))),
        part("article_description", F.get("keys", F.lit(1))),
        # what parts sentences is squeezed out of the whole text as well
        part("full_text", F.replace("squeezed", F.lit("\n"), F.lit(""))),
        part("product_name_brand", F.col("anchor")),
        part("raw_candidate", F.col("raw")),
        part("company_candidates", F.when(F.size("s") > 0, _candidates(F.element_at("s", -1)))),
    )
    bars = size - F.char_length(F.replace("text", F.lit("|"), F.lit("")))
    return known, rows.select("doc_id", expected, "anchor", size.alias("letters"), bars.alias("bars"), F.col("local").isNotNull().alias("later"), texts.alias("evidence"))


def _score(distance: Column, source: Column) -> Column:
    """Thousandths of a mention: base, weight of its evidence, kind of match, letters, nearness; 0 at least."""
    pick = lambda column, values: F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in values.items()])
    match = F.col("match_type")
    base = F.coalesce(pick(source, BASES), F.when((match == "full_alias") & (F.char_length("alias") < FULL_LETTERS), SHORT_FULL_ALIAS), pick(match, {k: v[0] for k, v in MATCHES.items()}))
    letters = F.least(F.lit(MOST_LETTER_POINTS), F.greatest(F.lit(0), F.char_length("alias") - FREE_LETTERS) * LETTER_POINTS)
    near = F.lit(0)
    for most, points in sorted(NEAR, reverse=True):
        near = F.when(distance <= most, points).otherwise(near)
    kind = F.when(source == "product_name_brand", 0).otherwise(pick(match, {k: v[1] for k, v in MATCHES.items()}) + letters)
    return F.greatest(F.lit(0), base + pick(source, WEIGHTS) + kind + near).cast("int")


#: How the aliases of evidence are read that is no running text.
HOW = {"product_name_brand": "longest", "raw_candidate": "longest", "company_candidates": "whole"}


#: Points for standing near the subject by tier, the last for standing farther or without one.
TIERS, NEAR_POINTS = [most for most, _ in sorted(NEAR)], [*[points for _, points in sorted(NEAR)], 0]


def _told(automaton, evidence: list[dict], anchor: str | None, expected: str | None, owned) -> list[tuple]:
    """(owner, source, start, score) of the marks that tell whose a document is; one of nulls where it has none.

    Of the best marks of each entity in each evidence these are: the one that wins, the best one of another entity, and,
    where a short alias wins, one that backs it. All that is asked of a document is the same for them as for all marks.
    """
    marks, sources, owned = [], list(WEIGHTS), owned.value
    for e in evidence if automaton is not None else ():
        source, text = e["source"], e["k"]
        if not text:
            continue
        how = HOW.get(source, "near")
        if how == "whole":
            found = {w: (-1, None) for w in text.split(" ") if w in owned}
        else:
            found = M.first_places(text, anchor if how == "near" else None, automaton, TIERS)
        if how == "longest" and found:
            word = min(found, key=lambda w: (-len(w), found[w][1], w))  # noqa: B023
            found = {word: found[word]}
        best, at = {}, sources.index(source)
        for word, (tier, start) in found.items():
            near, letters = (NEAR_POINTS[tier] if how == "near" else 0), -len(word)
            for owner, entity, kind, match_type, alone, scores in owned[word]:
                score = -near - scores[at]
                seen = best.get((entity, kind))
                if how == "near":
                    if seen is not None and seen[0] < score:
                        continue
                    rank = (score, letters, start, word, match_type, source, owner, start)
                elif match_type != "short_alias":
                    rank = (score, letters, 10**9, word, match_type, source, owner, None)
                elif source == "raw_candidate" and alone and expected is not None and kind == expected:
                    rank = (-scores[sources.index("industry_reresolve")], letters, 10**9, word, match_type, "industry_reresolve", owner, None)
                else:
                    continue
                if seen is None or rank < seen:
                    best[entity, kind] = rank
        marks += best.items()
    if not marks:
        return [(None, None, None, None)]
    (entity, _), first = min(marks, key=lambda m: (expected is None or m[0][1] != expected or m[1][4] == "short_alias", *m[1][:3], m[0][0], m[1][5]))
    telling, other = [first], min((rank for (e, _), rank in marks if e != entity), default=None)
    if other:
        telling.append(other)
    if first[4] == "short_alias":
        telling += [rank for (e, _), rank in marks if e == entity and rank[4] != "short_alias" and rank[1] <= first[1]][:1]
    return [(owner, sources.index(source), at, -score) for score, *_, source, owner, at in telling]


def scored_evidence(known: DataFrame | None, texts: DataFrame, words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, expected, keep, source, entity, kind, alias, match_type, start, score): marks, the best mention of each entity in each evidence.

    Every mention in a text is measured to the nearest place of the subject, in the row of the document, where an alias
    counts with its best mention, as no score is as low as 0 and the rest of it is the same for all mentions of an alias.
    Of a subject's name the longest alias speaks, if it has one owner; of a raw candidate likewise; if its longest alias
    has several, the owner of the expected kind speaks, if there is one only. Company candidates are whole words.

    Only the marks that tell whose a document is leave its row, three at most; of a dictionary beyond PART_BYTES all do,
    as its automata each see a part of them. With columns of the texts to keep, documents without a mark have a row too.
    ``texts`` has a list ``evidence``, or one row (doc_id, source, k) for each.
    """
    if "evidence" not in texts.columns:
        keyed = F.when(F.col("source") == "company_candidates", _candidates(F.col("k"))).otherwise(F.col("k")).alias("k")
        texts = texts.groupBy("doc_id").agg(F.collect_list(F.struct("source", keyed)).alias("evidence")).join(known.select("doc_id", "expected", "anchor"), "doc_id")
    # owners of an alias that are of one kind, among which that of the expected kind is looked for
    owners = durable(words.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("alias", "kind", "match_type"))).withColumn("_owner", F.monotonically_increasing_id()))
    size = owners.agg(F.coalesce(F.sum(F.octet_length("alias")), F.lit(0))).first()[0]
    if size > M.PART_BYTES:
        marks = _all_marks(texts, owners)
        return texts.select("doc_id", "expected", *keep).join(marks.drop("expected"), "doc_id", "left") if keep else marks
    listed = owners.where("alias <> ''").select("_owner", "alias", "entity", "kind", "match_type", (F.col("_n") == 1).alias("alone")).collect()
    sizes = owners.select("match_type", F.substring("alias", 1, FREE_LETTERS + MOST_LETTER_POINTS // LETTER_POINTS).alias("alias"), F.char_length("alias").alias("letters")).dropDuplicates(["match_type", "letters"])
    scored = sizes.select("match_type", "letters", F.array(*[_score(F.lit(None).cast("int"), F.lit(source)) for source in WEIGHTS]).alias("scores"))
    scores = {(r["match_type"], r["letters"]): r["scores"] for r in scored.collect()}
    order, owned = {e: i for i, e in enumerate(sorted({r["entity"] for r in listed}, key=lambda e: (e is not None, e)))}, {}
    for r in listed:
        owned.setdefault(r["alias"], []).append((r["_owner"], order[r["entity"]], r["kind"], r["match_type"], r["alone"], scores[r["match_type"], len(r["alias"])]))
    judge = functools.partial(_told, owned=owners.sparkSession.sparkContext.broadcast(owned))
    told = M.judged_rows(texts, ["doc_id", "expected", *keep], ["evidence", "anchor", "expected"], list(owned), judge, ["_owner", "_source", "start", "score"])
    named = told.join(F.broadcast(owners), "_owner", "left" if keep else "inner")
    source = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("_source").cast("int")).alias("source")
    return named.select("doc_id", "expected", *keep, source, "entity", "kind", "alias", "match_type", F.col("start").cast("int").alias("start"), F.col("score").cast("int").alias("score"))


def _all_marks(texts: DataFrame, owners: DataFrame) -> DataFrame:
    """All marks of all evidence, with a dictionary of any size."""
    texts = texts.select("doc_id", "expected", "anchor", F.explode("evidence").alias("e")).select("doc_id", "expected", "anchor", "e.*").where("k <> ''")
    how = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in HOW.items()], F.lit("near"))
    rows = texts.withColumn("k", F.explode(F.when(F.col("source") == "company_candidates", F.split("k", " ")).otherwise(F.array("k")))).withColumn("how", how)
    found = M.placed_mentions(rows, ["doc_id", "expected", "source"], "k", "anchor", "how", owners, TIERS)
    every = found.join(owners.drop("_owner"), "alias")
    short = F.col("match_type") == "short_alias"
    again = (F.col("source") == "raw_candidate") & short & (F.col("kind") == F.col("expected")) & (F.col("_n") == 1)
    every = every.where((F.col("how") == "near") | ~short | again).withColumn("source", F.when(again, "industry_reresolve").otherwise(F.col("source")))
    every = every.withColumns({c: F.when(F.col("how") == "near", F.col(c)) for c in ("start", "distance")})
    every = every.withColumn("score", _score(F.col("distance"), F.col("source")))
    order = F.struct((-F.col("score")).alias("o"), (-F.char_length("alias")).alias("l"), F.coalesce("start", F.lit(10**9)).alias("p"), "alias")
    # all that follows is by document, so rows move once
    best = every.repartition("doc_id").groupBy("doc_id", "expected", "source", "entity", "kind").agg(F.min(F.struct(order.alias("order"), "match_type", "start", "score")).alias("m"))
    return best.select("doc_id", "expected", "source", "entity", "kind", F.col("m.order.alias").alias("alias"), "m.match_type", "m.start", "m.score")


def attributed(known: DataFrame | None, marks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: entity, basis, confidence, margin to the next entity, needs_review and reason.

    The documents are those known; without them, those of the marks, whose columns to keep come first.

    The best mark wins (score, longer alias, earlier place, smaller entity, source), but where a kind is expected, the
    best one of that kind that is no short alias. A document is reviewed without any mark, with one of the wrong kind,
    with a short alias that no other evidence backs, and below LEAST_SCORE.
    """
    order = [F.desc("score"), F.desc(F.char_length("alias")), F.coalesce("start", F.lit(10**9)), "entity", "source"]
    mine = Window.partitionBy("doc_id")
    fits = F.coalesce((F.col("kind") == F.col("expected")) & (F.col("match_type") != "short_alias"), F.lit(False))
    first = F.row_number().over(mine.orderBy(fits.cast("int").desc(), *order))
    rows = marks.withColumn("_n", first)
    chosen = F.max(F.when((F.col("_n") == 1) & F.col("source").isNotNull(), F.struct("entity", "kind", "alias", "match_type", "source", "score"))).over(mine)
    rows = rows.withColumn("c", chosen)
    backs = (F.col("entity") == F.col("c.entity")) & (F.col("match_type") != "short_alias") & (F.char_length("alias") >= F.char_length("c.alias"))
    facts = rows.groupBy("doc_id", *(["expected", *keep] if known is None else [])).agg(F.max("c").alias("c"), F.max(backs).alias("backed"), F.max(F.when(F.col("entity") != F.col("c.entity"), F.col("score"))).alias("next"))
    out = facts if known is None else known.select("doc_id", "expected").join(facts, "doc_id", "left")
    lone = (F.col("c.match_type") == "short_alias") & ~F.col("backed")
    wrong = F.coalesce(F.col("expected") != F.col("c.kind"), F.lit(False))
    reason = F.when(F.col("c").isNull(), "no evidence").when(wrong, "kind conflict").when(lone, "short alias").when(F.col("c.score") < LEAST_SCORE, "low score").otherwise("")
    basis = F.when(F.col("c").isNull() | lone, "ambiguous_review").when(F.col("c.source") == "local_text", F.when(F.col("c.match_type") == "normalized", "local_full_name").otherwise("local_alias"))
    for source, name in BASIS.items():
        basis = basis.when(F.col("c.source") == source, name)
    confidence = F.least(F.lit(MOST_CONFIDENCE), F.coalesce(F.col("c.score"), F.lit(0)))
    return out.select("doc_id", *keep, F.col("c.entity").alias("entity"), basis.otherwise(F.col("c.source")).alias("basis"), confidence.cast("int").alias("confidence"), (F.col("c.score") - F.col("next")).cast("int").alias("margin"), (reason != "").alias("needs_review"), reason.alias("reason"))


def _pick(column: str, values: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_near_sql = "CASE " + " ".join(f"WHEN distance <= {most} THEN {points}" for most, points in NEAR) + " ELSE 0 END"
_score_sql = f"""greatest(0, coalesce({_pick("source", BASES)}, CASE WHEN match_type = 'full_alias' AND length(alias) < {FULL_LETTERS} THEN {SHORT_FULL_ALIAS} END, {_pick("match_type", {k: v[0] for k, v in MATCHES.items()})})
  + {_pick("source", WEIGHTS)} + CASE WHEN source = 'product_name_brand' THEN 0 ELSE {_pick("match_type", {k: v[1] for k, v in MATCHES.items()})} + least({MOST_LETTER_POINTS}, greatest(0, length(alias) - {FREE_LETTERS}) * {LETTER_POINTS}) END + {_near_sql})"""
_ORDER_SQL = "score DESC, length(alias) DESC, coalesce(start, 1000000000)"


@query(f"""
WITH {DICTIONARY_SQL},
r0 AS (SELECT doc_id, coalesce(text, '') AS text, {_SENTENCES} AS s FROM documents),
r1 AS (SELECT *, list_transform(s, lambda x: {_KEY.format("x")}) AS keys, list_filter(list_transform(string_split(s[1], ' '), lambda x: {_KEY.format("x")}), lambda x: x <> '') AS words FROM r0),
r2 AS (SELECT *, coalesce(list_sort(list_transform(words, lambda x: {{'l': -length(x), 'w': x}}))[1].w, '') AS anchor, coalesce(words[1], '') AS raw FROM r1),
r3 AS (SELECT *, list_min(list_filter(range(2, len(keys) + 1), lambda i: anchor <> '' AND contains(keys[i], anchor))) AS local FROM r2),
known AS MATERIALIZED (SELECT doc_id, CASE WHEN length(text) >= 2000 THEN 'long' WHEN length(text) < 500 THEN 'short' END AS expected, anchor, raw FROM r3),
ev AS MATERIALIZED (SELECT * FROM (
  SELECT doc_id, 'local_text' AS source, keys[local] AS k FROM r3 UNION ALL SELECT doc_id, 'previous_text', keys[local - 1] FROM r3
  UNION ALL SELECT doc_id, 'article_title', keys[1] FROM r3 UNION ALL SELECT doc_id, 'article_description', keys[2] FROM r3
  UNION ALL SELECT doc_id, 'full_text', {_KEY.format("text")} FROM r3 UNION ALL SELECT doc_id, 'product_name_brand', anchor FROM r3
  UNION ALL SELECT doc_id, 'raw_candidate', raw FROM r3) WHERE k <> ''),
{_mentions_sql("ev", "m")},
o0 AS (SELECT ev.doc_id, ev.source, string_split(k, anchor) AS parts, length(anchor) AS l FROM ev JOIN known USING (doc_id) WHERE anchor <> '' AND contains(k, anchor)),
o1 AS (SELECT doc_id, source, l, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM o0),
o2 AS (SELECT doc_id, source, i, n, sum(length(part) + l) OVER (PARTITION BY doc_id, source ORDER BY i) - l AS spot FROM o1),
near AS (SELECT m.doc_id, m.source, m.alias, m.start, min(abs(m.start - spot)) AS distance FROM m LEFT JOIN o2 ON o2.doc_id = m.doc_id AND o2.source = m.source AND i < n WHERE m.source NOT IN ('product_name_brand', 'raw_candidate') GROUP BY ALL),
lng AS (SELECT doc_id, source, arg_min(alias, {{'l': -length(alias), 's': start, 'a': alias}}) AS alias FROM m WHERE source IN ('product_name_brand', 'raw_candidate') GROUP BY doc_id, source),
lngo AS (SELECT * FROM lng JOIN dic USING (alias)),
re AS (SELECT lngo.*, count(*) OVER (PARTITION BY doc_id) AS c FROM lngo JOIN known USING (doc_id) WHERE source = 'raw_candidate' AND match_type = 'short_alias' AND kind = expected),
cand AS (SELECT DISTINCT doc_id, {_KEY.format("x")} AS alias FROM (SELECT doc_id, unnest(string_split(s[-1], ' ')) AS x FROM r3)),
every AS (
  SELECT doc_id, source, entity, kind, alias, match_type, start, distance FROM near JOIN dic USING (alias)
  UNION ALL SELECT doc_id, source, entity, kind, alias, match_type, NULL, NULL FROM lngo WHERE match_type <> 'short_alias'
  UNION ALL SELECT doc_id, 'industry_reresolve', entity, kind, alias, match_type, NULL, NULL FROM re WHERE c = 1
  UNION ALL SELECT doc_id, 'company_candidates', entity, kind, alias, match_type, NULL, NULL FROM cand JOIN dic USING (alias) WHERE match_type <> 'short_alias'),
sc AS (SELECT *, {_score_sql} AS score FROM every),
marks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, entity ORDER BY {_ORDER_SQL}, alias) AS r FROM sc) WHERE r = 1),
ch AS (SELECT marks.*, expected, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(kind = expected AND match_type <> 'short_alias', false) DESC, {_ORDER_SQL}, entity, source) AS n FROM marks JOIN known USING (doc_id)),
top AS (SELECT * FROM ch WHERE n = 1),
fa AS (SELECT ch.doc_id, bool_or(ch.entity = top.entity AND ch.match_type <> 'short_alias' AND length(ch.alias) >= length(top.alias)) AS backed, max(CASE WHEN ch.entity <> top.entity THEN ch.score END) AS nxt FROM ch JOIN top USING (doc_id) GROUP BY ch.doc_id),
j AS (SELECT known.doc_id, known.expected, top.entity, top.kind, top.match_type, top.source, top.score, nxt, match_type = 'short_alias' AND NOT backed AS lone FROM known LEFT JOIN top USING (doc_id) LEFT JOIN fa USING (doc_id)),
q AS (SELECT *, CASE WHEN entity IS NULL THEN 'no evidence' WHEN coalesce(expected <> kind, false) THEN 'kind conflict' WHEN lone THEN 'short alias' WHEN score < {LEAST_SCORE} THEN 'low score' ELSE '' END AS reason FROM j)
SELECT doc_id, entity, CASE WHEN entity IS NULL OR lone THEN 'ambiguous_review' WHEN source = 'local_text' THEN CASE WHEN match_type = 'normalized' THEN 'local_full_name' ELSE 'local_alias' END
  {" ".join(f"WHEN source = '{k}' THEN '{v}'" for k, v in BASIS.items())} ELSE source END AS basis,
  CAST(least({MOST_CONFIDENCE}, coalesce(score, 0)) AS INTEGER) AS confidence, CAST(score - nxt AS INTEGER) AS margin, reason <> '' AS needs_review, reason FROM q""")
def attribution(spark, d):
    """The entity of each document by nine kinds of evidence, with its margin and the reason of a review."""
    known, texts = evidence(spark, d)
    return attributed(known, scored_evidence(known, texts, dictionary(spark, d)))
