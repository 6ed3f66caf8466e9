"""Pair verdicts, merge and correction plans, attribution, validation and value clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.operators import resolve as V
from quillmart.operators import rules as R
from quillmart.plans.registry import query
from quillmart.sources.files import table

# Demonstration kinds that fit all others, and pairs that fit each other.
WILD, SOFT = ["STANDARD"], [("ECONOMY", "PROMO"), ("LARGE", "MEDIUM")]
PAIRS = """
WITH r AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_partkey % 24 AS INTEGER) AS month, string_split(p_name, ' ') AS words, string_split(p_name, ' ')[-1] AS family, p_size AS size FROM part),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.name = b.name AS same_name, a.brand = b.brand AS same_brand, abs(a.month - b.month) AS apart,
  len(list_intersect(a.words, b.words)) AS common, len(list_distinct(list_concat(a.words, b.words))) AS total,
  a.kind = b.kind OR a.kind = 'STANDARD' OR b.kind = 'STANDARD' OR (least(a.kind, b.kind), greatest(a.kind, b.kind)) IN (('ECONOMY', 'PROMO'), ('LARGE', 'MEDIUM')) AS fits
  FROM r a JOIN r b ON a.family = b.family AND a.size = b.size AND a.id < b.id),
q AS (SELECT *, least(100, CAST(55 * common // total + CASE WHEN same_name THEN 25 ELSE 0 END + CASE WHEN same_brand THEN 12 ELSE 0 END + CASE WHEN apart <= 3 THEN 8 ELSE 0 END + CASE WHEN fits THEN 6 ELSE 0 END AS INTEGER)) AS context FROM p)"""


def pairs(spark, d):
    """Every pair of parts of one family and size, with what the verdicts need."""
    words = F.split("p_name", " ")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), (F.col("p_partkey") % 24).cast("int").alias("month"), words.alias("words"), F.element_at(words, -1).alias("family"), F.col("p_size").alias("size"))

    def facts(met):
        """What names and kinds alone decide, and the points that they give."""
        met = met.withColumns({
            "same_name": F.col("left_name") == F.col("right_name"),
            "common": F.size(F.array_intersect("left_words", "right_words")),
            "total": F.size(F.array_union("left_words", "right_words")),
            "fits": V.compatible(F.col("left_kind"), F.col("right_kind"), WILD, SOFT),
        })
        points = F.expr("55 * common div total") + F.when(F.col("same_name"), 25).otherwise(0) + F.when(F.col("fits"), 6).otherwise(0)
        return met.select("_left", "_right", "_same", "same_name", "common", "total", "fits", points.cast("int").alias("points"))

    met = V.block_pairs(rows, ["family", "size"], "id", ["brand", "month"], ["name", "kind", "words"], facts, symmetric=True)
    met = met.withColumns({"same_brand": F.col("left_brand") == F.col("right_brand"), "apart": F.abs(F.col("left_month") - F.col("right_month"))})
    points = F.col("points") + F.when(F.col("same_brand"), 12).otherwise(0) + F.when(F.col("apart") <= 3, 8).otherwise(0)
    return met.withColumn("context", F.least(F.lit(100), points).cast("int"))


@query(PAIRS + " SELECT left_id, right_id, context FROM q")
def context_similarity(spark, d):
    return pairs(spark, d).select("left_id", "right_id", "context")


@query(PAIRS + """ SELECT left_id, right_id, fits AND apart <= 18 AND (same_name OR (same_brand AND apart <= 3 AND context >= 45) OR (common >= 2 AND context >= 38)) AS same_block,
  CASE WHEN NOT fits THEN 'kind' WHEN apart > 18 THEN 'months' WHEN same_name THEN 'same name' WHEN same_brand AND apart <= 3 AND context >= 45 THEN 'brand and month' WHEN common >= 2 AND context >= 38 THEN 'context' ELSE 'none' END AS reason FROM q""")
def same_block(spark, d):
    vetoes = [("kind", ~F.col("fits")), ("months", F.col("apart") > 18)]
    accepts = [("same name", 95, F.col("same_name")), ("brand and month", 74, F.col("same_brand") & (F.col("apart") <= 3) & (F.col("context") >= 45)), ("context", 45, (F.col("common") >= 2) & (F.col("context") >= 38))]
    v = V.verdict(vetoes, accepts, "none")
    return pairs(spark, d).select("left_id", "right_id", v["accepted"].alias("same_block"), v["reason"].alias("reason"))


@query(PAIRS + """, s AS (SELECT *, CASE WHEN apart > 6 OR NOT fits THEN 0 WHEN same_name AND same_brand THEN 96 WHEN same_name THEN 91 WHEN 100 * common >= 70 * total THEN 94 WHEN 100 * common >= 60 * total THEN 92 ELSE 100 * common // total END AS risk FROM q)
SELECT left_id, right_id, CAST(risk AS INTEGER) AS risk, CASE WHEN risk >= 75 THEN 'merge' WHEN risk >= 65 THEN 'review' ELSE 'keep' END AS action, risk >= 80 AS high FROM s""")
def pair_risk(spark, d):
    share = lambda n: 100 * F.col("common") >= n * F.col("total")
    risk = F.when((F.col("apart") > 6) | ~F.col("fits"), 0).when(F.col("same_name") & F.col("same_brand"), 96).when(F.col("same_name"), 91).when(share(70), 94).when(share(60), 92).otherwise(F.expr("100 * common div total"))
    rows = pairs(spark, d).select("left_id", "right_id", risk.cast("int").alias("risk"))
    action = F.when(F.col("risk") >= 75, "merge").when(F.col("risk") >= 65, "review").otherwise("keep")
    return rows.select("left_id", "right_id", "risk", action.alias("action"), (F.col("risk") >= 80).alias("high"))


@query(PAIRS + """ SELECT left_id, right_id, CASE WHEN NOT same_brand OR NOT fits THEN 0 WHEN same_name AND apart <= 6 THEN 97 WHEN same_name THEN 92 WHEN context >= 80 THEN 86 ELSE 0 END AS confidence,
  CASE WHEN NOT same_brand THEN 'other owner' WHEN NOT fits THEN 'other kind' WHEN same_name AND apart <= 6 THEN 'identity' WHEN same_name THEN 'late identity' WHEN context >= 80 THEN 'context' ELSE 'no rule' END AS reason FROM q""")
def merge_rule(spark, d):
    vetoes = [("other owner", ~F.col("same_brand")), ("other kind", ~F.col("fits"))]
    accepts = [("identity", 97, F.col("same_name") & (F.col("apart") <= 6)), ("late identity", 92, F.col("same_name")), ("context", 86, F.col("context") >= 80)]
    v = V.verdict(vetoes, accepts, "no rule")
    return pairs(spark, d).select("left_id", "right_id", v["confidence"].alias("confidence"), v["reason"].alias("reason"))


@query("""
WITH g AS (SELECT user_id, count(DISTINCT date_trunc('month', ts)) AS periods, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE value IS NULL) AS flagged, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN periods > 1 THEN 'review: periods' WHEN flagged > 0 THEN 'review: flag' WHEN kinds = 1 THEN 'merge' WHEN n >= 5 THEN 'merge: evidence' ELSE 'review: weak' END AS action FROM g""")
def group_action(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(F.date_trunc("month", "ts")).alias("periods"), F.count_distinct("event_type").alias("kinds"), F.count_if(F.col("value").isNull()).alias("flagged"), F.count(F.lit(1)).alias("n"))
    rules = [("review: periods", F.col("periods") > 1), ("review: flag", F.col("flagged") > 0), ("merge", F.col("kinds") == 1), ("merge: evidence", F.col("n") >= 5)]
    return g.select("user_id", R.first_match(rules, "review: weak").alias("action"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN 'reject: unknown' WHEN l_discount > 0.08 THEN 'review: unsure' WHEN p_size % 5 <> l_suppkey % 5 THEN 'review: key' ELSE 'apply' END AS action
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2""")
def coverage_merge_plan(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    joined = rows.join(part, F.col("p_partkey") == F.col("l_partkey") * 2, "left")
    rules = [("reject: unknown", F.col("p_partkey").isNull()), ("review: unsure", F.col("l_discount") > 0.08), ("review: key", F.col("p_size") % 5 != F.col("l_suppkey") % 5)]
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", R.first_match(rules, "apply").alias("action"))


BRAND_PLAN = """
WITH o AS (SELECT p_name, p_type, count(DISTINCT p_brand) AS owners, min(p_brand) AS owner FROM part GROUP BY ALL),
t AS (SELECT DISTINCT p_brand, p_name, p_size FROM part),
plan AS (SELECT p.p_partkey, CASE WHEN owners > 1 THEN 'review' WHEN p.p_brand = owner AND t.p_brand IS NULL THEN 'keep' WHEN t.p_brand IS NOT NULL THEN 'conflict' ELSE 'update' END AS action
  FROM part p JOIN o USING (p_name, p_type) LEFT JOIN t ON t.p_brand = o.owner AND t.p_name = p.p_name AND t.p_size = p.p_size + 1)"""


@query(BRAND_PLAN + " SELECT p_partkey, action FROM plan")
def brand_plan(spark, d):
    """What to do with a part's owner: several owners of a name go to review, a taken target is a conflict."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    owners = part.groupBy("p_name", "p_type").agg(F.count_distinct("p_brand").alias("owners"), F.min("p_brand").alias("owner"))
    taken = part.select(F.col("p_brand").alias("t_brand"), F.col("p_name").alias("t_name"), (F.col("p_size") - 1).alias("t_size")).distinct()
    joined = part.join(owners, ["p_name", "p_type"]).join(taken, (F.col("t_brand") == F.col("owner")) & (F.col("t_name") == F.col("p_name")) & (F.col("t_size") == F.col("p_size")), "left")
    rules = [("review", F.col("owners") > 1), ("keep", (F.col("p_brand") == F.col("owner")) & F.col("t_brand").isNull()), ("conflict", F.col("t_brand").isNotNull())]
    return joined.select("p_partkey", R.first_match(rules, "update").alias("action"))


@query(BRAND_PLAN + " SELECT action, count(*) AS n FROM plan GROUP BY action")
def plan_action_counts(spark, d):
    return brand_plan(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'jewel' WHEN p_name LIKE '%widget%' THEN 'tool' WHEN p_size > 40 THEN 'bulk' WHEN p_type = 'PROMO' THEN 'offer' ELSE 'other' END AS coverage,
  CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%widget%' THEN 'dictionary' WHEN p_size > 40 OR p_type = 'PROMO' THEN 'fallback' ELSE 'none' END AS basis FROM part""")
def coverage_classifier(spark, d):
    has = lambda w: F.contains(F.col("p_name"), F.lit(w))
    known, fallback = [("jewel", has("ring")), ("tool", has("widget"))], [("bulk", F.col("p_size") > 40), ("offer", F.col("p_type") == "PROMO")]
    any_of = lambda rules: rules[0][1] | rules[1][1]
    return table(spark, d, "part").select("p_partkey", R.first_match([*known, *fallback], "other").alias("coverage"), R.first_match([("dictionary", any_of(known)), ("fallback", any_of(fallback))], "none").alias("basis"))


# Demonstration pairs of a market segment and an order priority that may not go together.
BARRED = [("BUILDING", "5-LOW"), ("MACHINERY", "1-URGENT"), ("HOUSEHOLD", "4-NOT SPECIFIED")]


@query(f"SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_mktsegment, o_orderpriority) NOT IN ({', '.join(map(str, BARRED))})")
def segment_priority_check(spark, d):
    barred = spark.createDataFrame(BARRED, "c_mktsegment string, o_orderpriority string")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(F.broadcast(barred), ["c_mktsegment", "o_orderpriority"], "left_anti").select("o_orderkey")


@query(r"""
WITH m AS (SELECT doc_id, text, unnest([('licen', 30), ('copyright', 25), ('http', 20), ('the ', 10)]) AS w FROM documents),
h AS (SELECT doc_id, w[1] AS word, w[2] AS base, instr(lower(text), w[1]) AS place, instr(text, '.') AS anchor FROM m),
s AS (SELECT doc_id, word, place, base + CASE WHEN abs(place - anchor) <= 40 THEN 24 WHEN abs(place - anchor) <= 120 THEN 16 WHEN abs(place - anchor) <= 240 THEN 8 ELSE 0 END AS points FROM h WHERE place > 0)
SELECT doc_id, word, points FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, place) AS n FROM s) WHERE n = 1""")
def attribution_by_proximity(spark, d):
    """The word that a document is put down to: evidence points and a bonus for standing near the first full stop."""
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("base")) for w, n in (("licen", 30), ("copyright", 25), ("http", 20), ("the ", 10))])
    rows = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"), F.instr("text", ".").alias("anchor"), F.explode(words).alias("w"))
    hits = rows.select("doc_id", "w.word", "w.base", F.expr("locate(w.word, low)").alias("place"), "anchor")
    best = V.nearest_mention(hits.where("place > 0"), "doc_id", "place", "anchor", [(40, 24), (120, 16), (240, 8)], F.col("base"))
    return best.select("doc_id", "word", "points")


@query("""
SELECT p_partkey, CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'empty' WHEN length(p_name) < 8 THEN 'fragment' WHEN regexp_matches(p_name, '[0-9]') THEN 'versioned' WHEN p_name LIKE 'small %' OR p_name LIKE 'large %' THEN 'generic' WHEN p_name LIKE '% % %' THEN 'compound' ELSE 'official' END AS name_type FROM part""")
def name_candidate_type(spark, d):
    name = F.col("p_name")
    rules = [("empty", name.isNull() | (F.trim(name) == "")), ("fragment", F.char_length(name) < 8), ("versioned", name.rlike("[0-9]")), ("generic", name.startswith("small ") | name.startswith("large ")), ("compound", name.like("% % %"))]
    return table(spark, d, "part").select("p_partkey", R.first_match(rules, "official").alias("name_type"))


@query("""
SELECT o_orderkey, o_orderstatus IN ('P', 'X') OR o_totalprice > 400000 OR coalesce(list_contains(list(l_discount > 0.09), true), false) AS needed
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_totalprice""")
def verification_needed(spark, d):
    """An order that is risky itself or has a risky line; lines are reduced to one flag an order before the join."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_discount") > 0.09).alias("risky"))
    own = F.col("o_orderstatus").isin("P", "X") | (F.col("o_totalprice") > 400000)
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(lines, "o_orderkey", "left").select("o_orderkey", (own | F.coalesce("risky", F.lit(False))).alias("needed"))


@query("""
SELECT a.p_partkey, array_to_string(list_filter([CASE WHEN a.p_name IS DISTINCT FROM b.p_name THEN 'name' END, CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'brand' END, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'size' END], lambda x: x IS NOT NULL), ',') AS changed
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 3""")
def field_differences(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    other = part.select((F.col("p_partkey") - 3).alias("k"), *[F.col(c).alias(f"b_{c}") for c in ("p_name", "p_brand", "p_size")])
    fields = {c: (F.col(f"p_{c}"), F.col(f"b_p_{c}")) for c in ("name", "brand", "size")}
    return part.join(other, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.array_join(V.differences(fields), ",").alias("changed"))


@query("""
SELECT user_id, count(*) AS checks, greatest(0, 1 - count(*) FILTER (WHERE event_type = 'error') / count(*)) AS agreement, avg(least(1, greatest(0, coalesce(value, 0) / 100))) AS mean_confidence FROM events GROUP BY user_id""")
def verification_summary(spark, d):
    n = F.count(F.lit(1))
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("value", F.lit(0.0)) / 100))
    return table(spark, d, "events").groupBy("user_id").agg(n.alias("checks"), F.greatest(F.lit(0.0), 1 - F.count_if(F.col("event_type") == "error") / n).alias("agreement"), F.avg(held).alias("mean_confidence"))


# Demonstration channels of the event types.
CHANNELS = {"click": "web", "view": "web", "purchase": "shop", "signup": "office"}


@query("""
WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'office' END AS channel FROM events),
f AS (SELECT user_id, channel, min(event_id) AS first FROM s WHERE channel IS NOT NULL GROUP BY ALL)
SELECT u.user_id, coalesce(string_agg(channel, ',' ORDER BY first), '') AS channels FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN f ON u.user_id = f.user_id GROUP BY u.user_id""")
def channels_in_order(spark, d):
    """Channels of each user in order of first use; event types are reduced to their first event before they are listed."""
    firsts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    listed = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("l"))
    return listed.select("user_id", F.array_join(V.mapped(F.col("l.event_type"), CHANNELS), ",").alias("channels"))


@query("""
SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, 'k=' || regexp_extract(props, '"k": *([0-9]+)', 1) AS evidence FROM events WHERE regexp_matches(props, '"k": *[0-9]')""")
def evidence_text(spark, d):
    """Every path and value of the JSON evidence as a row and as text."""
    rows = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("path", "k"))
    return rows.where("path = 'k' AND k IS NOT NULL").select("event_id", "k", F.concat_ws("=", "path", F.col("k").cast("string")).alias("evidence"))


@query("""
WITH s AS (SELECT p_partkey, p_name AS a, regexp_replace(p_name, '^(small|large|red) ', '') AS b, regexp_replace(p_name, ' (ring|widget)$', '') AS c, regexp_replace(regexp_replace(p_name, '^(small|large|red) ', ''), ' (ring|widget)$', '') AS e FROM part)
SELECT DISTINCT p_partkey, unnest([a, b, c, e]) AS candidate FROM s""")
def core_key_candidates(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(V.stems(F.col("p_name"), ["small", "large", "red"], ["ring", "widget"])).alias("candidate"))


@query("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'ineligible' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'observed' WHEN o_custkey % 9 = 0 THEN 'queued' WHEN o_totalprice < 1000 THEN 'no snippet' ELSE 'enqueued' END AS status FROM orders) GROUP BY status""")
def enqueue_counts(spark, d):
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("observed")).distinct()
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice").join(seen, "o_orderkey", "left")
    rules = [("ineligible", F.col("o_orderstatus") == "P"), ("observed", F.col("observed").isNotNull()), ("queued", F.col("o_custkey") % 9 == 0), ("no snippet", F.col("o_totalprice") < 1000)]
    return rows.groupBy(R.first_match(rules, "enqueued").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_custkey, coalesce(min(strftime(o_orderdate, '%Y-%m')) FILTER (WHERE o_orderpriority = '1-URGENT'), strftime(min(o_orderdate), '%Y-%m')) AS month, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 0 AS explicit FROM orders GROUP BY o_custkey""")
def explicit_or_first_month(spark, d):
    month = F.date_format("o_orderdate", "yyyy-MM")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.min(F.when(urgent, month)), F.min(month)).alias("month"), (F.count_if(urgent) > 0).alias("explicit"))


# Ranks of the demonstration bases; a basis replaces one of its own rank or less.
BASES = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS basis, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS rank FROM orders)
SELECT a.o_orderkey, CASE WHEN b.rank >= a.rank THEN b.month ELSE a.month END AS month, CASE WHEN b.rank >= a.rank THEN b.basis ELSE a.basis END AS basis FROM r a LEFT JOIN r b ON b.o_orderkey = a.o_orderkey + 1""")
def release_month_update(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("basis"))
    new = rows.select((F.col("o_orderkey") - 1).alias("k"), F.col("month").alias("new_month"), F.col("basis").alias("new_basis"))
    better = F.col("k").isNotNull() & V.raised(BASES, F.col("basis"), F.col("new_basis"))
    pick = lambda c: F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.join(new, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", pick("month"), pick("basis"))


@query("""
SELECT 'customer' AS plan, c_custkey AS id, c_mktsegment AS before, NULL AS reason FROM customer WHERE c_acctbal < -900
UNION ALL SELECT 'supplier', s_suppkey, NULL, 'nation ' || s_nationkey FROM supplier WHERE s_acctbal < 0""")
def plans_united(spark, d):
    """Two plans as one table; a column that a plan lacks is null."""
    customers = table(spark, d, "customer").where("c_acctbal < -900").select(F.lit("customer").alias("plan"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("before"))
    suppliers = table(spark, d, "supplier").where("s_acctbal < 0").select(F.lit("supplier").alias("plan"), F.col("s_suppkey").alias("id"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("reason"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS active, strftime(TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)), '%Y-%m-%d') AS since,
  CASE WHEN c_nationkey % 3 = 0 THEN 'Nation ' || c_nationkey WHEN c_mktsegment = 'BUILDING' THEN 'Builder' ELSE c_name END AS label FROM customer""")
def export_cells(spark, d):
    """Values as an office sheet shows them: words for truth, ISO dates, and a label by precedence."""
    since = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")), "yyyy-MM-dd")
    label = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).when(F.col("c_mktsegment") == "BUILDING", "Builder").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("active"), since.alias("since"), label.alias("label"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \n]+|\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(lower(x), 'licen[sc]e') AND regexp_matches(x, '[0-9]'))) > 0 AS near, len(list_filter(l, lambda x: length(x) > 2000)) > 0 AS oversize FROM s""")
def metric_near_name(spark, d):
    """Whether some sentence holds both the name and a number, and whether some sentence is too long to judge."""
    l = X.sentences(F.coalesce("text", F.lit("")))  # noqa: E741
    near = F.exists(l, lambda x: F.lower(x).rlike("licen[sc]e") & x.rlike("[0-9]"))
    return table(spark, d, "documents").select("doc_id", near.alias("near"), F.exists(l, lambda x: F.char_length(x) > 2000).alias("oversize"))


@query("SELECT CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS BIGINT) AS late, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16') AS BIGINT) AS kept, count(DISTINCT event_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16') AS distinct_kept, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS BIGINT) AS ahead FROM events")
def look_back_counts(spark, d):
    ts = F.col("ts")
    inside = (ts >= F.lit("2024-01-10").cast("timestamp_ntz")) & (ts < F.lit("2024-01-16").cast("timestamp_ntz"))
    return table(spark, d, "events").agg(F.count_if(ts < F.lit("2024-01-10").cast("timestamp_ntz")).alias("late"), F.count_if(inside).alias("kept"), F.count_distinct(F.when(inside, F.col("event_id"))).alias("distinct_kept"), F.count_if(ts >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("ahead"))


@query(PAIRS + """ SELECT left_id, right_id, same_name OR total < 2 OR 100 * common >= 45 * total AS compatible FROM q""")
def alias_compatible(spark, d):
    return pairs(spark, d).select("left_id", "right_id", (F.col("same_name") | (F.col("total") < 2) | (100 * F.col("common") >= 45 * F.col("total"))).alias("compatible"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '([a-z]+)', 1), lambda x: length(x) >= 2 AND x NOT IN ('small', 'large', 'standard')))), ' ') || ' v' || p_size % 3 AS signature FROM part""")
def family_signature(spark, d):
    words = X.tokens(F.concat_ws(" ", "p_name", "p_type"), ["small", "large", "standard"])
    version = F.concat(F.lit(" v"), (F.col("p_size") % 3).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.array_join(F.array_sort(words), " "), version).alias("signature"))


@query(r"""
WITH t AS (SELECT doc_id, replace(trim(coalesce(text, '')), ',', '') AS s FROM documents),
m AS (SELECT doc_id, s, regexp_extract(s, '[-+]?[0-9]+(\.[0-9]+)?') AS n FROM t),
u AS (SELECT doc_id, n, lower(substr(s, instr(s, n) + length(n))) AS tail FROM m)
SELECT doc_id, coalesce(TRY_CAST(n AS DOUBLE) * CASE WHEN tail LIKE '%thousand%' THEN 1000 WHEN tail LIKE '%million%' THEN 1000000 WHEN tail LIKE '%\%%' ESCAPE '\' THEN 0.01 ELSE 1 END, 0.0) AS value FROM u""")
def metric_value(spark, d):
    """Of every text the first signed decimal, commas left out, times the first magnitude anywhere after it; 0 without a number."""
    rows = table(spark, d, "documents").select("doc_id", F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit(","), F.lit("")).alias("s"))
    rows = rows.select("doc_id", "s", F.regexp_extract("s", r"[-+]?[0-9]+(\.[0-9]+)?", 0).alias("n"))
    rows = rows.select("doc_id", "n", F.lower(F.expr("substring(s, instr(s, n) + char_length(n))")).alias("tail"))
    factor = F.when(F.contains("tail", F.lit("thousand")), 1000.0).when(F.contains("tail", F.lit("million")), 1000000.0).when(F.contains("tail", F.lit("%")), 0.01).otherwise(1.0)
    return rows.select("doc_id", F.coalesce(F.col("n").try_cast("double") * factor, F.lit(0.0)).alias("value"))


@query("""
SELECT count(*) FILTER (WHERE p_name LIKE 'small %' OR p_size < 5 OR p_brand IS NULL OR p_type = 'PROMO') AS triggered,
  count(*) FILTER (WHERE p_name LIKE 'small %') AS by_name, count(*) FILTER (WHERE p_size < 5) AS by_basis, count(*) FILTER (WHERE p_type = 'PROMO') AS by_partner, count(*) AS rows FROM part""")
def provider_trigger(spark, d):
    tests = {"by_name": F.col("p_name").startswith("small "), "by_basis": F.col("p_size") < 5, "by_partner": F.col("p_type") == "PROMO"}
    any_of = tests["by_name"] | tests["by_basis"] | F.col("p_brand").isNull() | tests["by_partner"]
    return table(spark, d, "part").agg(F.count_if(any_of).alias("triggered"), *[F.count_if(c).alias(n) for n, c in tests.items()], F.count(F.lit(1)).alias("rows"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \n]+|\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
f AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: regexp_matches(lower(x), 'licen[sc]e')), true) AS i FROM s)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 'reject: empty' WHEN coalesce(i, 0) = 0 THEN 'reject: not named' WHEN i > 5 THEN 'review: late' WHEN regexp_matches(lower(array_to_string(l[greatest(1, i - 1):i + 1], ' ')), 'not |without') THEN 'review: negated' ELSE 'create' END AS guard FROM f""")
def attribution_guard(spark, d):
    """What may be created from a document, by the sentence that names the subject and the sentences beside it."""
    l = X.sentences(F.coalesce("text", F.lit("")))  # noqa: E741
    rows = table(spark, d, "documents").select("doc_id", l.alias("l"))
    rows = rows.withColumn("i", F.array_position(F.transform("l", lambda x: F.lower(x).rlike("licen[sc]e")), True).cast("int"))
    first = F.greatest(F.col("i") - 1, F.lit(1))
    beside = F.lower(F.array_join(F.slice("l", first, F.col("i") + 2 - first), " "))
    rules = [("reject: empty", F.size("l") == 0), ("reject: not named", F.col("i") == 0), ("review: late", F.col("i") > 5), ("review: negated", beside.rlike("not |without"))]
    return rows.select("doc_id", R.first_match(rules, "create").alias("guard"))


@query("""
WITH r AS (SELECT a.p_partkey, a.p_name AS before, CASE WHEN b.p_partkey IS NOT NULL THEN b.p_name WHEN a.p_size % 3 = 0 THEN a.p_brand || ' ' || a.p_name END AS after,
  CASE WHEN b.p_partkey IS NOT NULL THEN 'verifier' WHEN a.p_size % 3 = 0 THEN 'candidate' ELSE 'rejected' END AS source FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 2 AND b.p_size % 4 = 0)
SELECT p_partkey, source, before, after FROM r WHERE after IS DISTINCT FROM before""")
def name_reconciliation(spark, d):
    """Audit rows of names that change: the verifier's suggestion, else a candidate of the text, else rejected (null)."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    suggested = part.where("p_size % 4 = 0").select((F.col("p_partkey") - 2).alias("k"), F.col("p_name").alias("suggestion"))
    by_verifier, by_text = F.col("k").isNotNull(), F.col("p_size") % 3 == 0
    after = F.when(by_verifier, F.col("suggestion")).when(by_text, F.concat_ws(" ", "p_brand", "p_name"))
    rows = part.join(suggested, F.col("p_partkey") == F.col("k"), "left")
    rows = rows.select("p_partkey", R.first_match([("verifier", by_verifier), ("candidate", by_text)], "rejected").alias("source"), F.col("p_name").alias("before"), after.alias("after"))
    return rows.where(~F.col("after").eqNullSafe(F.col("before")))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \n]+|\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, i, lower(array_to_string(l[greatest(1, i):i + 2], ' ')) AS around FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM s)),
p AS (SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN regexp_matches(around, 'licen[sc]e') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(around, 'copyright|permission') THEN 40 ELSE 0 END - CASE WHEN regexp_matches(around, '(^|[^a-z])not([^a-z]|$)|without') THEN 50 ELSE 0 END AS points FROM w)
SELECT doc_id, i, points FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) AS n FROM p) WHERE n = 1 AND points > 0""")
def best_context_window(spark, d):
    """The window of three sentences with the most points, the first of equals.

    Each sentence is matched once; a window adds up what its sentences hold. The best is exploded, so that no later
    filter is pushed below and computed again.
    """
    rows = table(spark, d, "documents").select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("l"))
    worth = {"licen[sc]e": 60, "copyright|permission": 40, "(^|[^a-z])not([^a-z]|$)|without": -50}
    marks = F.transform("l", lambda x: F.array(*[F.lower(x).rlike(p) for p in worth]))
    flagged = rows.select("doc_id", F.explode(F.array(marks)).alias("m"))
    near = lambda i: F.slice("m", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))
    any_holds = lambda i, k: F.exists(near(i), lambda f: f[k])
    points = lambda i: sum((F.when(any_holds(i, k), n).otherwise(0) for k, n in enumerate(worth.values())), F.lit(0))
    best = F.array_max(F.transform("m", lambda _, i: F.struct(points(i).alias("points"), (-i).alias("back"))))
    found = flagged.select("doc_id", F.explode(F.array(best)).alias("b"))
    return found.where("b.points > 0").select("doc_id", (-F.col("b.back")).alias("i"), "b.points")
