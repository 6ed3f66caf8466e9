"""Filters, ranks, counts and payload clean-up that other queries do not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.operators import cost as C
from quillmart.operators import filters as P
from quillmart.operators import rules as R
from quillmart.plans.registry import query
from quillmart.sources import files
from quillmart.sources.files import table

STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'Merged' WHEN 1 THEN 'active' WHEN 2 THEN 'ACTIVE ' WHEN 3 THEN 'rejected' END"


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {STATUS} AS status FROM orders) WHERE coalesce(status, 'active') NOT IN ('Merged', 'rejected')")
def status_exclusion(spark, d):
    return table(spark, d, "orders").where(P.status_not_in(F.expr(STATUS), ["Merged", "rejected"])).select("o_orderkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {STATUS} AS status FROM orders) WHERE lower(trim(coalesce(status, 'active'))) = 'active'")
def folded_active(spark, d):
    return table(spark, d, "orders").where(P.folded_equal(F.expr(STATUS), "active", "active")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT (trim(coalesce(p_name, '')) LIKE '%ring' OR trim(coalesce(p_name, '')) LIKE '%bolt' OR trim(coalesce(p_type, '')) LIKE '%ring' OR trim(coalesce(p_type, '')) LIKE '%bolt')")
def suffix_exclusion(spark, d):
    return table(spark, d, "part").where(P.no_suffix([F.col("p_name"), F.col("p_type")], ["ring", "bolt"])).select("p_partkey")


@query("SELECT p_partkey FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS review, CASE WHEN p_partkey % 7 > 0 THEN p_size / 50.0 END AS sure FROM part) WHERE NOT coalesce(review, false) AND coalesce(sure, 0) >= 0.5")
def confidence_gate(spark, d):
    review = F.when(F.col("p_partkey") % 3 == 0, F.lit(True)).when(F.col("p_partkey") % 3 == 1, F.lit(False))
    sure = F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") / 50.0)
    return table(spark, d, "part").where(P.confident(review, sure, 0.5)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def in_list_filter(spark, d):
    """Values of an IN list without empty values and sentinels; a list of those alone filters nothing."""
    part = P.one_of(table(spark, d, "part"), "p_brand", ["", None, "all"])
    return P.one_of(part, "p_type", ["PROMO", "", "all", "SMALL", None]).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal >= 0 THEN 'Y' ELSE 'N' END = 'Y' AND c_mktsegment NOT IN ('HOUSEHOLD', 'FURNITURE')")
def eligible_by_role(spark, d):
    """Product eligibility: the flag, and a role outside the list of excluded ones; a null role is none that is eligible."""
    flag = F.when(F.col("c_acctbal") >= 0, "Y").otherwise("N")
    return table(spark, d, "customer").where(P.included(flag, F.col("c_mktsegment"), F.lit(None), [], ["HOUSEHOLD", "FURNITURE"], [])).select("c_custkey")


@query(r"SELECT p_partkey FROM part WHERE length(trim(p_name)) >= 4 AND NOT regexp_matches(lower(p_name), '^(small|hot) ') AND NOT regexp_matches(lower(p_name), '(bolt|valve)$')")
def public_subjects(spark, d):
    """Subjects that may be shown: long enough, without a lead or an end that marks them as fragments."""
    low = F.lower("p_name")
    return table(spark, d, "part").where((F.char_length(F.trim("p_name")) >= 4) & ~low.rlike("^(small|hot) ") & ~low.rlike("(bolt|valve)$")).select("p_partkey")


@query("""SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL AND regexp_matches(strftime(o_orderdate, '%Y-%m'), '^[0-9]{4}-[0-9]{2}$') AND length(o_orderpriority) >= 5
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def safe_to_clear(spark, d):
    """Review flags that may be cleared: settled status, ids there, well-formed month, fit subject, and not blocked."""
    blocked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    fit = (F.col("o_orderstatus") == "F") & F.col("o_custkey").isNotNull() & month.rlike("^[0-9]{4}-[0-9]{2}$") & (F.char_length("o_orderpriority") >= 5)
    return table(spark, d, "orders").where(fit).select("o_orderkey").join(blocked, "o_orderkey", "left_anti")


@query("SELECT count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT o_custkey) AS customers FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def target_counts(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return orders.join(lines, "o_orderkey").agg(F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE p_name LIKE 'small %') AS prefixed, count(*) FILTER (WHERE p_size <= 3) AS tiny, count(*) FILTER (WHERE p_brand IS NULL OR p_brand = '') AS ownerless, count(*) FILTER (WHERE p_retailprice > 1000 AND p_type = 'PROMO') AS dear_promo FROM part")
def quality_audit(spark, d):
    n = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    c = F.col
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("rows"), n(c("p_name").startswith("small "), "prefixed"), n(c("p_size") <= 3, "tiny"), n(c("p_brand").isNull() | (c("p_brand") == ""), "ownerless"), n((c("p_retailprice") > 1000) & (c("p_type") == "PROMO"), "dear_promo"))


@query("SELECT event_type, CAST(k % 4 AS INTEGER) AS field, count(*) AS errors, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_value FROM (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL")
def field_error_counts(spark, d):
    field = (F.get_json_object("props", "$.k").cast("int") % 4).alias("field")
    return table(spark, d, "events").groupBy("event_type", field).agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("value").isNull()).alias("without_value"))


RAW = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '}', '') WHEN 2 THEN '' ELSE event_type END"


@query(f"SELECT event_id, json_valid(raw) AND raw LIKE '{{%' AS parsed, CASE WHEN json_valid(raw) AND raw LIKE '{{%' THEN CAST(json_extract_string(raw, '$.k') AS INTEGER) END AS k, CASE WHEN NOT (json_valid(raw) AND raw LIKE '{{%') THEN raw END AS kept FROM (SELECT event_id, {RAW} AS raw FROM events)")
def json_or_text(spark, d):
    """A JSON value where the text is an object, else the text itself."""
    return table(spark, d, "events").select("event_id", F.expr(RAW).alias("raw")).select("event_id", *files.json_or_raw(F.col("raw"), "k int", {"k": "k"}))


SAID = "CASE event_id % 6 WHEN 0 THEN '1,200' WHEN 1 THEN '3.7' WHEN 2 THEN '12 items' WHEN 3 THEN 'many' WHEN 4 THEN ' 45 ' END"


@query(rf"""
SELECT event_id, CAST(trunc(TRY_CAST(replace(trim(said), ',', '') AS DOUBLE)) AS BIGINT) AS whole, TRY_CAST(regexp_extract(replace(said, ',', ''), '[-+]?[0-9]+(\.[0-9]+)?') AS DOUBLE) AS number, coalesce(nullif(trim(said), ''), nullif(trim(event_type), ''), 'none') AS label,
  CASE WHEN lower(trim(said)) IN ('many', 'all') THEN true WHEN said IS NULL THEN NULL ELSE false END AS vague FROM (SELECT event_id, event_type, {SAID} AS said FROM events)""")
def payload_coercion(spark, d):
    """Values of a payload as the types they should have: whole numbers, decimals in text, flags, the first filled alias."""
    rows = table(spark, d, "events").select("event_id", "event_type", F.expr(SAID).alias("said"))
    return rows.select("event_id", files.whole_number(F.col("said")).alias("whole"), files.first_number(F.col("said")).alias("number"), F.coalesce(X.first_filled(F.col("said"), F.col("event_type")), F.lit("none")).alias("label"), F.lower(F.trim("said")).isin("many", "all").alias("vague"))


VERDICTS = """'{"a": {"verdict": "supported", "b": [{"verdict": "conflict"}, {"x": {"verdict": "supported"}}]}, "k": ' || CAST(event_id % 3 AS STRING) || ', "c": [' || CASE WHEN event_id % 2 = 0 THEN '{"verdict": "supported"}' ELSE '{"verdict": "missing"}' END || ']}'"""


@query(f"""
WITH RECURSIVE j AS (SELECT event_id, CAST({VERDICTS.replace('STRING', 'VARCHAR')} AS JSON) AS tree FROM events),
v AS (SELECT event_id, t.fullkey AS path, json_extract_string(t.value, '$') AS verdict FROM j, json_tree(j.tree) AS t WHERE t.key = 'verdict')
SELECT event_id, count(*) AS checks, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'supported') / count(*) AS confidence, string_agg(path || '=' || verdict, ';' ORDER BY path) AS found FROM v GROUP BY event_id""")
def verdict_tree(spark, d):
    """Every verdict of an arbitrary JSON tree with its path; confidence is the share of supported ones."""
    found = files.tree_values(table(spark, d, "events").select("event_id", F.expr(VERDICTS).alias("tree")), "event_id", "tree", "verdict")
    right = F.count_if(F.col("value") == "supported")
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("checks"), right.alias("supported"), (right / F.count(F.lit(1))).alias("confidence"), F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit("="), "value"))), ";").alias("found"))


@query("""
SELECT o_orderkey, strptime(regexp_extract(said, ', ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8})', 1), '%d %b %Y %H:%M:%S') AS at
FROM (SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN ' +0900' ELSE ' GMT' END AS said FROM orders)""")
def rfc_dates(spark, d):
    """Dates written as RFC 2822 text with a zone, read as the wall clock they show."""
    said = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, " +0900").otherwise(" GMT"))
    return table(spark, d, "orders").select("o_orderkey", files.rfc_timestamp(said).alias("at"))


@query("SELECT conv_id, turn, regexp_replace(said, '^(?:(?:well|so|now)[ ,]+){1,3}', '') AS stripped FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'well, so now, ' WHEN 1 THEN 'so so so so ' ELSE '' END || role AS said FROM conversations)")
def stripped_prefixes(spark, d):
    lead = F.when(F.col("turn") % 3 == 0, "well, so now, ").when(F.col("turn") % 3 == 1, "so so so so ").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_prefixes(F.concat(lead, F.col("role")), ["well", "so", "now"]).alias("stripped"))


@query("""
SELECT conv_id, turn, CAST(CASE WHEN actual > 0 THEN actual WHEN length(said) > 0 THEN greatest(1, ceil(length(said) * 2 / 5)) WHEN chars > 0 THEN greatest(1, ceil(chars * 2 / 5)) ELSE 0 END AS BIGINT) AS tokens,
  CASE WHEN actual > 0 THEN 'actual' WHEN length(said) > 0 THEN 'text' WHEN chars > 0 THEN 'rough' ELSE 'none' END AS quality
FROM (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN conv_id % 50 END AS actual, CASE WHEN conv_id % 4 = 1 THEN text END AS said, CASE WHEN conv_id % 4 = 2 THEN length(text) ELSE 0 END AS chars FROM conversations)""")
def token_resolution(spark, d):
    kind = F.col("conv_id") % 4
    tokens, quality = C.resolved_tokens(F.when(kind == 0, F.col("conv_id") % 50), F.when(kind == 1, F.col("text")), F.when(kind == 2, F.char_length("text")).otherwise(0))
    return table(spark, d, "conversations").select("conv_id", "turn", tokens.alias("tokens"), quality.alias("quality"))


@query("SELECT p_name, p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def preferred_columns(spark, d):
    return files.preferred_first(table(spark, d, "part"), ["p_name", "absent", "p_partkey"])


@query("SELECT c_custkey, c_name FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS n FROM customer) WHERE n <= least(1000, 5 * 40)) WHERE c_mktsegment <> 'MACHINERY' ORDER BY n LIMIT 40")
def over_fetched_top(spark, d):
    """Five times the wanted rows, a thousand at most, filtered afterwards and cut: what the filter leaves may be fewer."""
    return R.over_fetched(table(spark, d, "customer"), [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], F.col("c_mktsegment") != "MACHINERY", 40).select("c_custkey", "c_name")


VARIANTS = {"ends": "[.!?]+[ \n]+|\n+", "lines": "\n+", "stops": "[.!?]+", "ends_or_marks": "[.!?;:]+[ \n]+|\n+"}
_count = lambda p: f"len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '{p}'), lambda x: trim(x, ' ')), lambda x: x <> ''))"


@query("SELECT doc_id, " + ", ".join(f"CAST({_count(p)} AS INTEGER) AS {name}" for name, p in VARIANTS.items()) + " FROM documents")
def sentence_variants(spark, d):
    """Sentences of a text by each of four ways to cut it."""
    return table(spark, d, "documents").select("doc_id", *[F.size(X.sentences(F.coalesce("text", F.lit("")), p)).alias(name) for name, p in VARIANTS.items()])


RANK = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 WHEN l_quantity >= 25 THEN 3 ELSE 4 END"


@query(f"SELECT l_orderkey, l_shipdate AS chosen, CAST(k AS INTEGER) AS rank FROM (SELECT *, {RANK} AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {RANK}, l_shipdate, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def release_choice_five_ranks(spark, d):
    """The line of each order by five classes of basis, then date, then number, with partial minima before the shuffle."""
    best = F.min(F.struct(F.expr(RANK).alias("rank"), "l_shipdate", "l_linenumber")).alias("b")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", F.col("b.l_shipdate").alias("chosen"), "b.rank")


_like = lambda c, w: f"contains(lower(coalesce({c}, '')), '{w}') OR contains(translate(lower(coalesce({c}, '')), ' -/', ''), '{w.replace(' ', '')}')"
OWN = ["p_name", "p_brand", "p_type", "CAST(p_size AS {0})", "CAST(p_partkey AS {0})", "CAST(p_retailprice AS {0})", "p_brand || ' ' || p_name"]
WORD = "brand#1 red"


@query(f"""
SELECT p_partkey FROM part p WHERE {" OR ".join(_like(c.format("VARCHAR"), WORD) for c in OWN)}
  OR EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND ({_like("s_name", "000007")}))
  OR EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = p_partkey AND ({_like("o_orderpriority", "1 urg")}) AND o_totalprice > 450000)
  OR EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey = p_partkey AND ({_like("c_name", "00033")}))
  OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND ({_like("l_returnflag", "r")}) AND l_quantity >= 49)
  OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND ({_like("l_linestatus", "f")}) AND l_discount >= 0.1 AND l_quantity <= 2)""")
def keyword_search_everywhere(spark, d):
    """A keyword, raw or compacted, in seven columns of the row or in any of five child sources; one semi-join of keys."""
    like = lambda c, w: P.holds_word(c, w)
    part = table(spark, d, "part")
    line = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    by = lambda rows, key, other: line.select("l_partkey", key).join(rows.select(F.col(other).alias(key)), key, "left_semi").select("l_partkey")
    buyers = table(spark, d, "customer").where(like(F.col("c_name"), "00033")).select(F.col("c_custkey").alias("o_custkey"))
    found = [
        by(table(spark, d, "supplier").where(like(F.col("s_name"), "000007")), "l_suppkey", "s_suppkey"),
        by(orders.where(like(F.col("o_orderpriority"), "1 urg") & (F.col("o_totalprice") > 450000)), "l_orderkey", "o_orderkey"),
        by(orders.join(buyers, "o_custkey", "left_semi"), "l_orderkey", "o_orderkey"),
        line.where(like(F.col("l_returnflag"), "r") & (F.col("l_quantity") >= 49)).select("l_partkey"),
        line.where(like(F.col("l_linestatus"), "f") & (F.col("l_discount") >= 0.1) & (F.col("l_quantity") <= 2)).select("l_partkey"),
    ]
    keys = found[0]
    for more in found[1:]:
        keys = keys.unionByName(more)
    own = F.lit(False)
    for c in OWN:
        own = own | like(F.expr(c.format("STRING")), WORD)
    return P.mentioning(part, "p_partkey", own, keys).select("p_partkey")
