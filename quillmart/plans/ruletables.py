"""Screening, classifying and excerpts of documents by a table of rules that comes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.operators import ruletable as T
from quillmart.plans.registry import query
from quillmart.sources.files import table

#: Ten classes; a benchmark item belongs to one by its key and gives its longer words as keywords.
CLASSES, LETTERS, STRONG_LETTERS = 10, 6, 9
RULES_SQL = f"""
i AS (SELECT item_id % {CLASSES} AS class, lower(text) AS text FROM benchmark),
rules AS MATERIALIZED (SELECT DISTINCT 'class ' || class AS label, keyword, CASE WHEN length(keyword) >= {STRONG_LETTERS} THEN 'strong' ELSE 'medium' END AS strength,
  CASE WHEN class = 9 THEN -30 ELSE 5 + CAST(class AS INTEGER) * 3 END AS weight, CAST((class * 7) % {CLASSES} AS INTEGER) AS priority FROM (SELECT class, unnest(regexp_extract_all(text, '([a-z]{{{LETTERS},}})', 1)) AS keyword FROM i))"""
_GRAMS = ", ".join(f"lead(c, {i}) OVER o" for i in range(1, LETTERS))


def _hits_sql(texts: str) -> str:
    """Keywords in the column t of (doc_id, i): by their first letters, then whole."""
    return f"""
ch AS (SELECT doc_id, i, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS p FROM {texts} WHERE length(t) >= {LETTERS}),
gr AS (SELECT doc_id, i, p, concat_ws('', c, {_GRAMS}) AS g FROM ch WINDOW o AS (PARTITION BY doc_id, i ORDER BY p)),
hits AS MATERIALIZED (SELECT gr.doc_id, gr.i, label, rules.keyword, strength, weight, priority, count(*) AS times, min(p - 1) AS first FROM gr JOIN rules ON g = left(rules.keyword, {LETTERS}) JOIN {texts} t ON t.doc_id = gr.doc_id AND t.i = gr.i WHERE substring(t.t, p, length(rules.keyword)) = rules.keyword GROUP BY ALL)"""


def rules(spark, d) -> DataFrame:
    items = table(spark, d, "benchmark").select((F.col("item_id") % CLASSES).alias("class"), F.lower("text").alias("text"))
    words = items.select("class", F.explode(F.regexp_extract_all("text", F.lit(f"([a-z]{{{LETTERS},}})"), 1)).alias("keyword")).distinct()
    weight = F.when(F.col("class") == 9, -30).otherwise(5 + F.col("class").cast("int") * 3)
    return words.select(F.concat(F.lit("class "), F.col("class").cast("string")).alias("label"), "keyword", F.when(F.char_length("keyword") >= STRONG_LETTERS, "strong").otherwise("medium").alias("strength"), weight.alias("weight"), ((F.col("class") * 7) % CLASSES).cast("int").alias("priority"))


def _hits(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return T.rule_hits(docs, ["doc_id"], "t", rules(spark, d))


_docs_sql = "t AS MATERIALIZED (SELECT doc_id, 0 AS i, lower(coalesce(text, '')) AS t FROM documents)"


@query(f"""
WITH {RULES_SQL}, {_docs_sql}, {_hits_sql("t")},
o AS (SELECT doc_id, label, max(weight) AS weight, count(*) AS n FROM hits GROUP BY ALL),
s AS (SELECT doc_id, CAST(least(100, greatest(0, sum(weight))) AS INTEGER) AS score, count(*) AS labels, CAST(sum(n) AS BIGINT) AS keywords FROM o GROUP BY doc_id)
SELECT doc_id, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'skip' END AS tier, labels, keywords FROM s""")
def rule_screening(spark, d):
    """Documents with any keyword: additive score of the rule table, its tier, and how many labels and keywords hit."""
    return T.additive_scores(_hits(spark, d), ["doc_id"])


@query(f"""
WITH {RULES_SQL}, {_docs_sql}, {_hits_sql("t")},
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY strength = 'medium', priority, label, first, keyword) AS r FROM hits)
SELECT doc_id, label, CASE strength WHEN 'strong' THEN {T.STRONG} ELSE {T.MEDIUM} END AS confidence, keyword FROM b WHERE r = 1""")
def rule_classes(spark, d):
    """The class of each document with a keyword: strong keywords first, then priority."""
    return T.classified(_hits(spark, d), ["doc_id"])


_SENTENCES = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+[ \n]+|\n+'), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""
WITH {RULES_SQL}, z AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), y AS MATERIALIZED (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM z),
t AS MATERIALIZED (SELECT doc_id, i, lower(sentence) AS t FROM y), {_hits_sql("t")},
n AS (SELECT DISTINCT doc_id, label, unnest([i - 1, i, i + 1]) AS i FROM hits WHERE strength = 'strong'),
l AS (SELECT doc_id, label, list(sentence ORDER BY i) AS l FROM n JOIN y USING (doc_id, i) GROUP BY ALL),
k AS (SELECT doc_id, label, list_reduce(list_prepend({{'u': CAST(0 AS BIGINT), 'k': CAST([] AS VARCHAR[])}}, list_transform(l, lambda x: {{'u': length(x), 'k': [x]}})),
  lambda a, x: CASE WHEN a.u + x.u <= {T.BUDGET} THEN {{'u': a.u + x.u, 'k': list_append(a.k, x.k[1])}} ELSE a END).k AS kept FROM l)
SELECT doc_id, label, CAST(len(kept) AS INTEGER) AS sentences, array_to_string(kept, ' ') AS snippet FROM k""")
def rule_snippets(spark, d):
    """For each document and class the sentences with a strong keyword and their neighbours, 3,000 characters at most."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence"))
    found = T.rule_hits(docs.select("doc_id", "i", F.lower("sentence").alias("t")), ["doc_id", "i"], "t", rules(spark, d).where("strength = 'strong'"))
    return T.class_snippets(docs, "doc_id", found.select("doc_id", "i", "label").distinct())


QUOTED, UNQUOTED = '"([^"\\n]{3,40})"', "(?:^|[.!?] )([A-Z][a-z]{4,} [a-z]{3,})"


@query(rf"""
WITH c AS (
  SELECT doc_id, trim(unnest(regexp_extract_all(text, '{QUOTED}', 1))) AS name, 96 AS confidence, generate_subscripts(regexp_extract_all(text, '{QUOTED}', 1), 1) AS place FROM documents
  UNION ALL SELECT doc_id, trim(unnest(regexp_extract_all(text, '{UNQUOTED}', 1))), 90, generate_subscripts(regexp_extract_all(text, '{UNQUOTED}', 1), 1) FROM documents),
k AS (SELECT *, regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', '', 'g') AS k FROM c)
SELECT doc_id, name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY confidence DESC, place) AS r FROM k WHERE k <> '') WHERE r = 1""")
def scored_candidates(spark, d):
    """Names that a document puts in quotation marks or begins a sentence with, once each, with their confidence."""
    return T.candidate_names(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id", "t", QUOTED, UNQUOTED)


@query(f"""
WITH {RULES_SQL}, {_docs_sql}, {_hits_sql("t").replace("min(p - 1) AS first", "min(p - 1) AS first, list(p - 1) AS places")},
ph AS (SELECT keyword, '<' || min(label) || '>' AS template FROM rules GROUP BY keyword),
o AS (SELECT DISTINCT doc_id, keyword, unnest(places) AS start FROM hits),
l AS (SELECT doc_id, list({{'s': start, 'l': -length(keyword), 'w': template}} ORDER BY start, -length(keyword)) AS x FROM o JOIN ph USING (keyword) GROUP BY doc_id),
f AS (SELECT t.doc_id, t.t, list_reduce(list_prepend({{'a': CAST(0 AS BIGINT), 'p': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}}, list_transform(x, lambda h: {{'a': CAST(h.s AS BIGINT), 'p': [h.w], 'n': CAST(-h.l AS BIGINT)}})),
  lambda d, h: CASE WHEN h.a >= d.a THEN {{'a': h.a + h.n, 'p': list_concat(d.p, [substring(t.t, d.a + 1, h.a - d.a), h.p[1]]), 'n': d.n + 1}} ELSE d END) AS r FROM t JOIN l USING (doc_id))
SELECT t.doc_id, CAST(coalesce(r.n, 0) AS INTEGER) AS replaced, CASE WHEN r IS NULL THEN t.t ELSE array_to_string(r.p, '') || substring(t.t, r.a + 1, length(t.t)) END AS text FROM t LEFT JOIN f USING (doc_id)""")
def templated_texts(spark, d):
    """Documents with the keywords of the rule table replaced by their class, longest first."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    phrases = rules(spark, d).groupBy("keyword").agg(F.concat(F.lit("<"), F.min("label"), F.lit(">")).alias("template"))
    return T.templated(docs, "doc_id", "t", phrases)
