"""Text functions, rules, screening, dictionary matching and cost over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.operators import cost as C
from quillmart.operators import rules as R
from quillmart.operators.rows import best_per_group
from quillmart.plans.registry import query
from quillmart.sources.files import table

# Fixed values of the demonstration rules: weights in hundredths with their keywords.
WEIGHTS = [(30, ["license", "licensed"]), (30, ["email", "@"]), (20, ["http", "www"]), (20, ["the", "der", "les", "los"]), (-50, ["trash", "loser", "pathetic"])]
ENTITIES = ["apache", "apache license", "mit", "mit license", "gnu", "creative commons", "cc"]
LOW = "lower(coalesce(text, ''))"
SCORE = "greatest(0, least(100, " + " + ".join(f"CASE WHEN regexp_matches({LOW}, '{'|'.join(w)}') THEN {n} ELSE 0 END" for n, w in WEIGHTS) + "))"
TIER = "CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'skip' END"
SENT = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+[ \n]+|\n+'), lambda x: trim(x)), lambda x: x <> '')"


def docs(spark, d):
    return table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n\f\x0b]+', ' ', 'g')) AS compact, translate(lower(coalesce(source, '')), ' -/', '') AS source_key FROM documents")
def normalize_text(spark, d):
    plain = F.trim(F.regexp_replace("text", r"[ \t\r\n\f\x0b]+", " "))
    return table(spark, d, "documents").select("doc_id", plain.alias("compact"), X.compacted(F.col("source")).alias("source_key"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM pages")
def strip_html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"))


@query("SELECT sha256(coalesce(nullif(trim(text), ''), '' || chr(10))) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    """The first document of each content hash. The hash is grouped with partial sums, so copies cost no window."""
    hashed = table(spark, d, "documents").select("doc_id", X.article_hash(F.col("text"), F.lit(""), F.lit("")).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS hash FROM documents")
def input_hash_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.input_hash(F.col("text")).alias("hash"))


@query("SELECT role, CAST(sum(greatest(1, CAST(ceil(length(text) * 2 / 5) AS BIGINT))) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY role")
def token_estimate(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.sum(X.rough_tokens(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("turns"))


@query(f"SELECT doc_id, CAST(len({SENT}) AS INTEGER) AS sentences FROM documents")
def sentence_split_count(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


@query(r"""
SELECT doc_id, CAST(floor(TRY_CAST(replace(regexp_extract(low, '([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS DECIMAL(20, 4)) *
  CASE regexp_extract(low, '[0-9][0-9,.]*\s*(thousand|million|billion)', 1) WHEN 'thousand' THEN 1000 WHEN 'million' THEN 1000000 WHEN 'billion' THEN 1000000000 ELSE 1 END) AS BIGINT) AS amount
FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)""")
def amount_parse(spark, d):
    """The first amount that a document names; null without one."""
    return docs(spark, d).select("doc_id", X.amount(F.col("text")).alias("amount"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_extract(text, '(20[0-9]{2})[-./ ]?(0[1-9]|1[0-2])', 1) <> '' THEN regexp_extract(text, '(20[0-9]{2})[-./ ]?(0[1-9]|1[0-2])', 1) || '-' || regexp_extract(text, '(20[0-9]{2})[-./ ]?(0[1-9]|1[0-2])', 2)
  WHEN contains(lower(text), 'last month') THEN strftime(said - INTERVAL 1 MONTH, '%Y-%m') WHEN contains(lower(text), 'this month') THEN strftime(said, '%Y-%m') END AS month
FROM (SELECT doc_id, coalesce(text, '') AS text, DATE '2024-01-31' + CAST(doc_id % 365 AS INTEGER) AS said FROM documents)""")
def yearmonth_parse(spark, d):
    """The first month that a document names, or means by this or last month; documents are dated by their id."""
    at = F.expr("date_add(DATE'2024-01-31', CAST(doc_id % 365 AS INT))")
    return docs(spark, d).select("doc_id", X.year_month(F.col("text"), at).alias("month"))


@query("SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS versions FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(v[0-9]+|[0-9]+\\.[0-9]+)', 1) AS l FROM documents))".replace("\\\\", "\\"))
def version_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(X.versions(F.col("text")), ",").alias("versions"))


def _screened(spark, d):
    low = F.lower("text")
    scored = docs(spark, d).select("doc_id", low.alias("low"), "source").withColumn("score", R.additive_score(F.col("low"), WEIGHTS))
    return scored.withColumn("tier", R.tier(F.col("score")))


@query(f"""
SELECT doc_id, CAST(score AS INTEGER) AS score, {TIER} AS tier, keywords FROM (SELECT doc_id, {SCORE} AS score,
  array_to_string(list_filter(['license', 'trash', 'the', 'http'], lambda w: contains({LOW}, w)), ',') AS keywords FROM documents)""")
def screening_score(spark, d):
    words = R.matched(F.col("low"), ["license", "trash", "the", "http"])
    return _screened(spark, d).select("doc_id", "score", "tier", F.array_join(words, ",").alias("keywords"))


@query(f"SELECT tier, count(*) AS n FROM (SELECT {TIER} AS tier FROM (SELECT {SCORE} AS score FROM documents)) GROUP BY tier")
def tier_histogram(spark, d):
    return _screened(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT doc_id, CASE WHEN regexp_matches({LOW}, 'licen[sc]e') THEN 'legal' WHEN regexp_matches({LOW}, 'trash|loser') THEN 'abuse' WHEN regexp_matches({LOW}, 'http') THEN 'link' ELSE 'other' END AS label,
  CASE WHEN regexp_matches({LOW}, 'licen[sc]e') THEN 92 WHEN regexp_matches({LOW}, 'trash|loser|http') THEN 74 ELSE 30 END AS confidence FROM documents""")
def rule_classifier_primary(spark, d):
    low = F.lower("text")
    label = R.first_match([("legal", low.rlike("licen[sc]e")), ("abuse", low.rlike("trash|loser")), ("link", low.contains("http"))], "other")
    rows = docs(spark, d).select("doc_id", label.alias("label"))
    return rows.withColumn("confidence", F.when(F.col("label") == "legal", 92).when(F.col("label") != "other", 74).otherwise(30))


@query(f"""
SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN length(text) < 40 THEN 'short' WHEN regexp_matches({LOW}, '!!') THEN 'shouting' WHEN regexp_matches({LOW}, '\\*\\*\\*|###|%%%') THEN 'marked'
  WHEN regexp_matches({LOW}, '\\|') THEN 'table' WHEN score = 0 THEN 'irrelevant' ELSE 'eligible' END AS reason FROM (SELECT doc_id, text, {SCORE} AS score FROM documents)""".replace("\\\\", "\\"))
def eligibility_cascade(spark, d):
    t = F.col("text")
    low = F.lower(t)
    rules = [("empty", F.char_length(F.trim(t)) == 0), ("short", F.char_length(t) < 40), ("shouting", low.contains("!!")), ("marked", low.rlike(r"\*\*\*|###|%%%")), ("table", low.contains("|")), ("irrelevant", R.additive_score(low, WEIGHTS) == 0)]
    return docs(spark, d).select("doc_id", R.first_match(rules, "eligible").alias("reason"))


HITS = r"regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g')), '\b(creative commons|apache license|mit license|apache|gnu|mit|cc)\b', 1)"


@query(f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({HITS}) AS word FROM documents) GROUP BY ALL")
def dictionary_match_longest(spark, d):
    hits = R.dictionary_hits(docs(spark, d), "doc_id", "text", ENTITIES)
    return hits.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


#: Owner of each dictionary word.
OWNERS = {"apache": "apache", "apache license": "apache", "mit": "mit", "mit license": "mit", "gnu": "gnu", "creative commons": "cc", "cc": "cc"}


#: Quotation marks and the plain ones in their place, as SQL texts.
MARKS, PLAIN = "'“”«»‘’'", "repeat(chr(34), 4) || repeat(chr(39), 2)"
_entities = "t"
for _entity, _sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _entities = f"replace({_entities}, '{_entity}', {_sign})"


@query(rf"""
SELECT page_id, trim(regexp_replace(translate(nfc_normalize({_entities}), {MARKS}, {PLAIN}), '\s+', ' ', 'g')) AS title
FROM (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def base_titles(spark, d):
    """Titles of pages as plain text: entities resolved, characters composed, quotation marks made plain."""
    from quillmart.functions.udfs import base_text

    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", base_text(title).alias("title"))


FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WHOLE_WORDS_SQL = f"""
WITH w(word) AS (VALUES {", ".join(f"('{w}')" for w in ENTITIES)}), f AS (SELECT doc_id, {FOLD} AS t FROM documents),
p AS (SELECT doc_id, t, word, string_split(t, word) AS parts FROM f, w WHERE contains(t, word)),
u AS (SELECT doc_id, t, word, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM p),
o AS (SELECT doc_id, t, word, i, n, sum(length(part) + length(word)) OVER (PARTITION BY doc_id, word ORDER BY i) - length(word) AS start FROM u),
m AS (SELECT doc_id, word, CAST(start AS INTEGER) AS start FROM o WHERE i < n AND NOT (start > 0 AND regexp_matches(substring(t, CAST(start AS BIGINT), 1), '[\\p{{L}}\\p{{N}}_]')) AND NOT regexp_matches(substring(t, CAST(start AS BIGINT) + length(word) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))"""


@query(WHOLE_WORDS_SQL + " SELECT * FROM m")
def dictionary_mentions(spark, d):
    """Every place where a dictionary word stands as a whole word, those inside others included; only A-Z are folded."""
    return R.dictionary_mentions(docs(spark, d), "doc_id", "text", ENTITIES)


@query(WHOLE_WORDS_SQL + f""", e(word, entity) AS (VALUES {", ".join(map(str, OWNERS.items()))})
SELECT doc_id, entity, word, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY length(word) DESC, start, word) AS r FROM m JOIN e USING (word)) WHERE r = 1""")
def best_entity_mention(spark, d):
    return R.best_mentions(dictionary_mentions(spark, d), "doc_id", OWNERS)


@query(f"SELECT doc_id, count(DISTINCT word) AS entities FROM (SELECT doc_id, unnest({HITS}) AS word FROM documents) WHERE length(word) >= 3 GROUP BY doc_id HAVING count(DISTINCT word) >= 2")
def multi_entity_gate(spark, d):
    hits = R.dictionary_hits(docs(spark, d), "doc_id", "text", ENTITIES).where(F.char_length("word") >= 3)
    return hits.groupBy("doc_id").agg(F.count_distinct("word").alias("entities")).where("entities >= 2")


@query(f"""
WITH s AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l))) AS i FROM (SELECT doc_id, {SENT} AS l FROM documents)),
w AS (SELECT doc_id, i, sentence, string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS i, around FROM w WHERE regexp_matches(lower(sentence), 'licen[sc]e|trash')""")
def snippet_windows(spark, d):
    """Sentences around a hit, cut out of the sentence array before it is exploded: no shuffle, one row a hit."""
    rows = docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("l"))
    hits = F.array_compact(F.transform("l", lambda x, i: F.when(F.lower(x).rlike("licen[sc]e|trash"), i)))
    around = lambda i: F.array_join(F.slice("l", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ")
    found = rows.select("doc_id", F.explode(F.transform(hits, lambda i: F.struct(i.alias("i"), around(i).alias("around")))).alias("h"))
    return found.select("doc_id", "h.i", "h.around")


@query("""SELECT doc_id, span, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), 'under the ([A-Z][A-Za-z]+ [A-Za-z]+ ?[A-Za-z]*)', 1)) AS span FROM documents) GROUP BY ALL""")
def launch_candidates(spark, d):
    spans = F.explode(F.regexp_extract_all("text", F.lit("under the ([A-Z][A-Za-z]+ [A-Za-z]+ ?[A-Za-z]*)"), 1))
    return docs(spark, d).select("doc_id", spans.alias("span")).groupBy("doc_id", "span").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id LIMIT 40")
def hash_order_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(40)


@query("""
WITH w AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z]+)', 1), lambda x: length(x) >= 5))) AS t FROM benchmark),
k AS (SELECT item_id, t, unnest(t) AS token FROM w), p AS (SELECT DISTINCT a.item_id AS left_id, b.item_id AS right_id, a.t AS x, b.t AS y FROM k a JOIN k b ON a.token = b.token AND a.item_id < b.item_id)
SELECT left_id, right_id, CAST(len(list_intersect(x, y)) AS INTEGER) AS common, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS jaccard FROM p""")
def token_jaccard_pairs(spark, d):
    """Benchmark items that share a token, which is the block; similarity of their token sets."""
    words = table(spark, d, "benchmark").select("item_id", F.array_sort(X.tokens(F.col("text"), [""], 5)).alias("t"))
    keys = words.select("item_id", F.explode("t").alias("token"))
    a, b = keys.withColumnRenamed("item_id", "left_id"), keys.withColumnRenamed("item_id", "right_id")
    pairs = a.join(b, "token").where("left_id < right_id").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).cast("int").alias("common"))
    sizes = words.select("item_id", F.size("t").alias("n"))
    pairs = pairs.join(sizes.select(F.col("item_id").alias("left_id"), F.col("n").alias("nl")), "left_id").join(sizes.select(F.col("item_id").alias("right_id"), F.col("n").alias("nr")), "right_id")
    return pairs.select("left_id", "right_id", "common", (F.col("common") / (F.col("nl") + F.col("nr") - F.col("common"))).alias("jaccard"))


@query("SELECT event_type, count(*) AS runs, avg(value) AS mean_latency, sum(coalesce(value, 0)) AS total, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS slow FROM events GROUP BY event_type")
def llm_metrics_groupby(spark, d):
    value = F.coalesce("value", F.lit(0.0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.avg("value").alias("mean_latency"), F.sum(value).alias("total"), F.count_if(F.col("value") > 100).alias("slow")).orderBy("event_type")


# Demonstration prices in thousandths of a unit for a million tokens.
PRICES = [("p1", "default", 100, 400, 25), ("p1", "user", 300, 2500, 75), ("p2", "default", 50, 200, 10)]
COST_SQL = """
WITH price(provider, model, i, o, c) AS (VALUES """ + ", ".join(map(str, PRICES)) + """),
run AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'p1' WHEN 1 THEN 'p2' ELSE 'p3' END AS provider, role AS model, turn, greatest(1, CAST(ceil(length(text) * 2 / 5) AS BIGINT)) AS tokens FROM conversations),
priced AS (SELECT run.*, coalesce(a.i, b.i) AS pi, coalesce(a.o, b.o) AS po, coalesce(a.c, b.c) AS pc FROM run LEFT JOIN price a USING (provider, model) LEFT JOIN price b ON b.provider = run.provider AND b.model = 'default'),
cost AS (SELECT *, tokens * pi + 10 * po + 5 * pc AS full_cost, CASE WHEN turn % 2 = 0 THEN (tokens * pi + 10 * po + 5 * pc) // 2 ELSE tokens * pi + 10 * po + 5 * pc END AS paid FROM priced)"""  # fmt: skip


def _costs(spark, d):
    prices = spark.createDataFrame(PRICES, "provider string, model string, in_per_m long, out_per_m long, cached_per_m long")
    provider = F.when(F.col("conv_id") % 3 == 0, "p1").when(F.col("conv_id") % 3 == 1, "p2").otherwise("p3")
    runs = table(spark, d, "conversations").select(provider.alias("provider"), F.col("role").alias("model"), "turn", X.rough_tokens(F.col("text")).alias("tokens"))
    priced = C.priced(runs, prices)
    cost = lambda batch: C.cost_nano(F.col("tokens"), F.lit(10), F.lit(5), batch)
    return priced.withColumn("full_cost", cost(F.lit(False))).withColumn("paid", cost(F.col("turn") % 2 == 0))


@query(COST_SQL + " SELECT provider, model, count(*) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(paid), 0) AS BIGINT) AS cost, CAST(count(*) FILTER (WHERE pi IS NULL) AS BIGINT) AS unpriced FROM cost GROUP BY GROUPING SETS ((), (provider, model), (model))")
def cost_summary(spark, d):
    return spark.sql("""SELECT provider, model, count(*) AS runs, sum(tokens) AS tokens, coalesce(sum(paid), 0) AS cost, count_if(in_per_m IS NULL) AS unpriced
        FROM {costs} GROUP BY GROUPING SETS ((), (provider, model), (model))""", costs=_costs(spark, d))


@query(COST_SQL + """ SELECT CAST(coalesce(sum(full_cost), 0) AS BIGINT) AS baseline, CAST(coalesce(sum(paid), 0) AS BIGINT) AS actual, CAST(greatest(0, coalesce(sum(full_cost), 0) - coalesce(sum(paid), 0)) AS BIGINT) AS saved,
  CAST(coalesce(round_even(avg(tokens) FILTER (WHERE tokens > 0), 0), 700) AS BIGINT) AS average_tokens FROM cost""")
def savings_breakdown(spark, d):
    average = F.coalesce(F.bround(F.avg(F.when(F.col("tokens") > 0, F.col("tokens"))), 0), F.lit(700)).cast("long")
    full, paid = (F.coalesce(F.sum(c), F.lit(0)) for c in ("full_cost", "paid"))
    return _costs(spark, d).agg(full.alias("baseline"), paid.alias("actual"), F.greatest(F.lit(0), full - paid).alias("saved"), average.alias("average_tokens"))


@query("""
SELECT count(*) AS documents, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS judged, count(DISTINCT d.doc_id) FILTER (WHERE toxic = 1) AS violating,
  coalesce(count(*) FILTER (WHERE toxic = 1) / nullif(count(*) FILTER (WHERE l.doc_id IS NOT NULL), 0), 0) AS ratio FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def guard_summary(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("_id"), "toxic")
    rows = table(spark, d, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("_id"), "left")
    bad, judged = F.count_if(F.col("toxic") == 1), F.count_if(F.col("_id").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("documents"), judged.alias("judged"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("violating"), F.coalesce(F.try_divide(bad, judged), F.lit(0.0)).alias("ratio"))
