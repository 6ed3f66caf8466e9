"""Lookups, decisions, counters and plans of the collecting and resolving workflow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.operators import lookups as L
from quillmart.operators import rules as R
from quillmart.plans.registry import query
from quillmart.sources.files import table


@query("""
SELECT event_id, coalesce(a.p_partkey, b.p_partkey) AS part, CASE WHEN a.p_partkey IS NOT NULL THEN 'identity' WHEN b.p_partkey IS NOT NULL THEN 'size' ELSE 'none' END AS basis
FROM events e LEFT JOIN part a ON a.p_partkey = e.user_id LEFT JOIN (SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_size) b ON b.p_size = e.user_id % 60""")
def tiered_lookup(spark, d):
    part = table(spark, d, "part")
    exact = part.select(F.col("p_partkey").alias("user_id"), F.col("p_partkey").alias("part"))
    by_size = part.groupBy(F.col("p_size").cast("long").alias("size")).agg(F.min("p_partkey").alias("part"))
    rows = table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") % 60).alias("size"))
    return L.tiered(rows, [("identity", exact), ("size", by_size)], "part", "basis").select("event_id", "part", "basis")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey = p_partkey % 10 OR s_suppkey = p_partkey")
def either_key_join(spark, d):
    pairs = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("canonical"))
    return L.either_key(table(spark, d, "supplier").select("s_suppkey"), pairs, "s_suppkey", ["canonical", "p_partkey"]).select("s_suppkey", "p_partkey").distinct()


@query("""
SELECT p.p_partkey, coalesce(c.p_partkey, p.p_partkey) AS shown_key, coalesce(c.p_name, p.p_name) AS shown_name
FROM part p LEFT JOIN part c ON p.p_partkey % 7 = 0 AND c.p_partkey = p.p_partkey + 1""")
def canonical_hop(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    target = part.select(F.col("p_partkey").alias("target"), F.col("p_name").alias("target_name"))
    own = part.withColumn("target", F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") + 1))
    # parts without a target need no join; as null keys they would all meet in one task
    hop = own.where("target IS NOT NULL").join(target.withColumn("hit", F.lit(True)), "target", "left")
    out = hop.select("p_partkey", F.when(F.col("hit"), F.col("target")).otherwise(F.col("p_partkey")).alias("shown_key"), F.coalesce("target_name", "p_name").alias("shown_name"))
    return out.unionByName(own.where("target IS NULL").select("p_partkey", F.col("p_partkey").alias("shown_key"), F.col("p_name").alias("shown_name")))


@query("""
SELECT event_id, coalesce(c_name, s_name) AS target FROM events LEFT JOIN customer ON event_type IN ('click', 'view') AND c_custkey = user_id
LEFT JOIN supplier ON event_type NOT IN ('click', 'view') AND s_suppkey = user_id""")
def conditional_scope_join(spark, d):
    """The table that an event points into depends on its type: each kind of event is joined with its own table only."""
    seen = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("target"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("target"))
    of_customers = events.where(seen).join(customers, "user_id", "left")
    of_suppliers = events.where(~seen).join(suppliers, "user_id", "left")
    return of_customers.unionByName(of_suppliers).select("event_id", "target")


@query("""
SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01' AND o_orderstatus = 'F') GROUP BY c_mktsegment""")
def scoped_counts(spark, d):
    inside = (F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1996-01-01") & (F.col("o_orderstatus") == "F")
    scope = table(spark, d, "orders").where(inside).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(scope, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def followup_top(spark, d):
    best = table(spark, d, "customer").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(10)
    return best.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("""
SELECT event_type, count(*) AS items, count(*) FILTER (WHERE value IS NULL) AS failed, count(*) FILTER (WHERE value > 100) AS done, count(*) FILTER (WHERE value <= 100) AS pending FROM events GROUP BY event_type""")
def job_counters(spark, d):
    value = F.col("value")
    counters = {"failed": value.isNull(), "done": value > 100, "pending": value <= 100}
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counters.items()])


@query("""
SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, strftime(max(o_orderdate), '%Y-%m') AS latest_month, (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order FROM orders""")
def data_status(spark, d):
    last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("latest_month"), last.alias("last_order"))


@query("SELECT count(*) AS lines, count(DISTINCT l_suppkey) AS companies, count(DISTINCT l_orderkey) AS articles, count(DISTINCT l_partkey) AS products FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def dashboard_summary(spark, d):
    chosen = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, d, "lineitem").join(chosen, "l_partkey", "left_semi")
    return lines.agg(F.count(F.lit(1)).alias("lines"), *[F.count_distinct(c).alias(n) for n, c in (("companies", "l_suppkey"), ("articles", "l_orderkey"), ("products", "l_partkey"))])


@query("""
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, max(value) AS best FROM events GROUP BY user_id""")
def cluster_rollup(spark, d):
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")  # at most one entry per type
    return table(spark, d, "events").groupBy("user_id").agg(kinds.alias("kinds"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("value").alias("best"))


@query("""
SELECT CAST(sum(n) * (sum(n) - 1) // 2 AS BIGINT) AS all_pairs, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS blocked_pairs FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_size)""")
def pairs_avoided(spark, d):
    n = F.sum("n")
    blocks = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return blocks.agg(F.expr("sum(n) * (sum(n) - 1) div 2").alias("all_pairs"), F.sum(F.expr("n * (n - 1) div 2")).alias("blocked_pairs"), n.alias("_n")).drop("_n")


@query("""
SELECT o_orderkey, CASE WHEN strftime(max(l_shipdate), '%Y-%m') > strftime(any_value(o_orderdate) + INTERVAL 2 MONTH, '%Y-%m') THEN 'veto' ELSE 'ok' END AS verdict FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def future_month_veto(spark, d):
    ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM").alias("month"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(ship, "o_orderkey")
    late = F.col("month") > F.date_format(F.add_months(F.to_date("o_orderdate"), 2), "yyyy-MM")
    return rows.select("o_orderkey", F.when(late, "veto").otherwise("ok").alias("verdict"))


@query("""
SELECT d.doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'reject' WHEN q IS NOT NULL THEN CASE q WHEN 1 THEN 'accept' ELSE 'review' END WHEN length(text) > 400 THEN 'accept' ELSE 'review' END AS decision,
  CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 'gate' WHEN q IS NOT NULL THEN 'model' ELSE 'rule' END AS decided_by
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
def decision_precedence(spark, d):
    """Hard gates before the model's verdict before rules."""
    verdict = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = table(spark, d, "documents").select("doc_id", "text").join(verdict, "doc_id", "left")
    gate, model = F.char_length(F.trim(F.coalesce("text", F.lit("")))) < 20, F.col("q").isNotNull()
    decision = R.first_match([("reject", gate), ("accept", model & (F.col("q") == 1)), ("review", model), ("accept", F.char_length("text") > 400)], "review")
    return rows.select("doc_id", decision.alias("decision"), R.first_match([("gate", gate), ("model", model)], "rule").alias("decided_by"))


@query(r"""
SELECT event_id, concat_ws(',', CASE WHEN k IS NULL THEN 'no_k' END, CASE WHEN k > 50 THEN 'large_k' END, CASE WHEN value IS NULL THEN 'no_value' END, CASE WHEN event_type IN ('error') THEN 'error_type' END) AS issues
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS INTEGER) AS k FROM events)""")
def schema_issues(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    checks = [("no_k", F.col("k").isNull()), ("large_k", F.col("k") > 50), ("no_value", F.col("value").isNull()), ("error_type", F.col("event_type") == "error")]
    issues = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in checks])
    return table(spark, d, "events").withColumn("k", k).select("event_id", issues.alias("issues"))


LOW = "lower(coalesce(text, ''))"


@query(f"""
SELECT doc_id, CAST(greatest(0, least(100, CASE WHEN contains({LOW}, 'license') THEN 60 ELSE 0 END + CASE WHEN contains({LOW}, 'released') AND NOT regexp_matches({LOW}, 'not released|never released') THEN 40 ELSE 0 END
  - CASE WHEN contains({LOW}, 'reserved') THEN 50 ELSE 0 END)) AS INTEGER) AS score FROM documents""")
def event_score(spark, d):
    """Additive evidence in hundredths; one kind counts only where it is not negated."""
    low = F.lower(F.coalesce("text", F.lit("")))
    said = low.contains("released") & ~low.rlike("not released|never released")
    points = F.when(low.contains("license"), 60).otherwise(0) + F.when(said, 40).otherwise(0) - F.when(low.contains("reserved"), 50).otherwise(0)
    return table(spark, d, "documents").select("doc_id", F.greatest(F.lit(0), F.least(F.lit(100), points)).alias("score"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 210 THEN text WHEN contains(head, '.') AND stop >= 80 THEN substring(text, 1, stop) ELSE head END AS summary
FROM (SELECT doc_id, text, substring(text, 1, 210) AS head, 211 - instr(reverse(substring(text, 1, 210)), '.') AS stop FROM documents)""")
def summary_shortened(spark, d):
    return table(spark, d, "documents").select("doc_id", L.shortened(F.col("text")).alias("summary"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1994 AND 1996 THEN strftime(o_orderdate, '%Y-%m') ELSE '' END AS shown_month FROM orders")
def display_month_mask(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.year("o_orderdate").between(1994, 1996), F.date_format("o_orderdate", "yyyy-MM")).otherwise("").alias("shown_month"))


@query("SELECT c_mktsegment, count(*) AS candidates FROM customer WHERE c_acctbal < 0 OR c_nationkey IN (3, 7) OR c_mktsegment IS NULL OR c_custkey % 11 = 0 GROUP BY c_mktsegment")
def triage_counts(spark, d):
    flags = (F.col("c_acctbal") < 0) | F.col("c_nationkey").isin(3, 7) | F.col("c_mktsegment").isNull() | (F.col("c_custkey") % 11 == 0)
    return table(spark, d, "customer").where(flags).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("candidates"))


@query("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN e.user_id % 5 <> 1 THEN 'outside' WHEN i.event_id IS NOT NULL THEN 'skipped' WHEN e.event_type = 'error' THEN 'failed' ELSE 'completed' END AS status
  FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_id % 3 = 0) i ON i.event_id = e.event_id) GROUP BY status""")
def import_status(spark, d):
    """Results of a batch: what lies outside its scope or was imported before is left alone, so a replay changes nothing."""
    events = table(spark, d, "events")
    before = events.where("event_id % 3 = 0").select("event_id", F.lit(True).alias("imported")).dropDuplicates(["event_id"])
    status = R.first_match([("outside", F.col("user_id") % 5 != 1), ("skipped", F.col("imported").isNotNull()), ("failed", F.col("event_type") == "error")], "completed")
    return events.join(before, "event_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CASE WHEN bad = n THEN 'mark' WHEN bad > 0 THEN 'keep_clean_sources' ELSE 'untouched' END AS action, count(*) AS customers
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS bad FROM orders GROUP BY o_custkey) GROUP BY action""")
def cleanup_plan(spark, d):
    """An entity is marked only if all its sources are bad."""
    sources = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("bad"))
    action = R.first_match([("mark", F.col("bad") == F.col("n")), ("keep_clean_sources", F.col("bad") > 0)], "untouched")
    return sources.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("customers"))


@query("""
SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'reject' WHEN a.p_size < 10 THEN 'review' WHEN a.p_brand <> b.p_brand THEN 'review' ELSE 'accept' END AS verdict,
  CASE WHEN b.p_partkey IS NULL THEN 'unknown_id' WHEN a.p_size < 10 THEN 'low_confidence' WHEN a.p_brand <> b.p_brand THEN 'key_mismatch' ELSE '' END AS reason FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 25""")
def merge_plan_check(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    target = part.select((F.col("p_partkey") - 25).alias("p_partkey"), F.col("p_brand").alias("target_brand"), F.lit(True).alias("known"))
    rules = [("unknown_id", F.col("known").isNull()), ("low_confidence", F.col("p_size") < 10), ("key_mismatch", F.col("p_brand") != F.col("target_brand"))]
    rows = part.join(target, "p_partkey", "left").withColumn("reason", R.first_match(rules, ""))
    return rows.select("p_partkey", R.first_match([("reject", F.col("reason") == "unknown_id"), ("review", F.col("reason") != "")], "accept").alias("verdict"), "reason")


@query("""
SELECT role, count(*) AS requests, count(DISTINCT sha256(coalesce(text, ''))) AS stored, count(*) - count(DISTINCT sha256(coalesce(text, ''))) AS hits FROM conversations GROUP BY role""")
def cache_hits(spark, d):
    """Requests answered from a cache keyed by role and hash of the input."""
    keyed = table(spark, d, "conversations").groupBy("role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy("role").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("stored"), (F.sum("n") - F.count(F.lit(1))).alias("hits"))


@query("""
SELECT n_nationkey, query_text FROM (SELECT n_nationkey, query_text, row_number() OVER (PARTITION BY n_nationkey ORDER BY i) AS r FROM (
  SELECT n_nationkey, n_name || ' ' || t AS query_text, i FROM nation, (VALUES (0, 'launch'), (1, 'new plan'), (2, 'launch award')) v(i, t))) WHERE r <= 2""")
def generated_queries(spark, d):
    """Search texts from templates, a capped number for each entity."""
    templates = F.array(*[F.lit(t) for t in ("launch", "new plan", "launch award")])
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.transform(F.slice(templates, 1, 2), lambda t: F.concat("n_name", F.lit(" "), t))).alias("query_text"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'premium' WHEN o_orderstatus = 'F' THEN 'coverage' ELSE 'unknown' END AS amount_class,
  'company:' || o_custkey || '|product:' || lower(replace(o_orderpriority, '-', '')) AS identity FROM orders""")
def amount_class_identity(spark, d):
    kind = R.first_match([("premium", F.col("o_orderpriority").rlike("^[12]")), ("coverage", F.col("o_orderstatus") == "F")], "unknown")
    identity = F.concat(F.lit("company:"), F.col("o_custkey").cast("string"), F.lit("|product:"), X.compacted(F.col("o_orderpriority"), "-"))
    return table(spark, d, "orders").select("o_orderkey", kind.alias("amount_class"), identity.alias("identity"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'imported' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'prepared' ELSE 'running' END AS state FROM events GROUP BY user_id")
def batch_state(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"))
    state = R.first_match([("imported", F.col("last_type") == "purchase"), ("failed", F.col("last_type") == "error"), ("prepared", F.col("last_type") == "signup")], "running")
    return last.select("user_id", "last_type", state.alias("state"))


# Fixed value: the characters that the snippets of a document may have.
BUDGET = 3000


@query(f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+[ \n]+|\n+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_reduce(l, lambda a, x: {{'used': CASE WHEN a.used + length(x) <= {BUDGET} THEN a.used + length(x) ELSE a.used END, 'kept': CASE WHEN a.used + length(x) <= {BUDGET} THEN list_append(a.kept, x) ELSE a.kept END}}, {{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS VARCHAR[])}}).kept, ' ') AS snippet FROM s""")
def budgeted_snippets(spark, d):
    """Sentences of a document within a budget of characters; one that is too long is passed over, later ones may fit."""
    docs = table(spark, d, "documents").select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("l"))
    return docs.select("doc_id", F.array_join(L.capped_texts(F.col("l"), BUDGET), " ").alias("snippet"))


@query("""
SELECT event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, ts, event_id) AS r FROM events) WHERE r = 1""")
def best_mention(spark, d):
    order = Window.partitionBy("event_type").orderBy(F.desc_nulls_last("value"), "ts", "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(order)).where("r = 1").select("event_type", "ts", "event_id")
