"""Star views, pivots, filters and joins over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.operators import filters as P
from quillmart.operators.pivot import Metric, PivotSpec, pivot, repeat_groups
from quillmart.operators.rows import best_per_group, chunked, merged_on_key, repointed
from quillmart.plans.registry import query
from quillmart.sources.files import table


#: Order lines that a task joins and groups; what it holds does not grow with the tables.
LINES_A_TASK = 250_000


def star(spark, d: str) -> DataFrame:
    """Order lines with their order, its year, customer, nation, region and part; the dimensions are joined by key.

    Orders get their places and lines their parts before the two meet, in tasks of LINES_A_TASK; there all lines of an
    order are together, so what is counted by order needs no other shuffle of lines.
    """
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    lines = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    tasks = max(spark.sparkContext.defaultParallelism, -(-line.count() // LINES_A_TASK))
    # with the year worked out behind it the exchange keeps its tasks, which Spark raises where both sides are bare exchanges
    years = placed.repartition(tasks, "o_orderkey").withColumn("order_year", F.date_format("o_orderdate", "yyyy"))
    return lines.repartition(tasks, "l_orderkey").join(years, F.col("l_orderkey") == F.col("o_orderkey"))


@query("""
SELECT r_name, p_brand, strftime(o_orderdate, '%Y') AS order_year, count(DISTINCT l_orderkey) AS orders,
       coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0.0) AS returned, max(l_quantity) AS largest
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey
GROUP BY ALL""")
def pivot_product_primary(spark, d):
    rows = star(spark, d)
    spec = PivotSpec(["r_name", "p_brand"], [Metric("orders", "count_distinct", "l_orderkey"), Metric("returned", "sum", "l_extendedprice", F.col("l_returnflag") == "R"), Metric("largest", "max", "l_quantity")], ["order_year"])
    return pivot(rows, spec)


@query("""
SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0.0) AS returned_quantity, CAST(0 AS INTEGER) AS missing
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def pivot_filtered_metrics(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return pivot(rows, PivotSpec(["p_brand"], [Metric("accepted", "count", "l_orderkey", F.col("l_returnflag") == "A"), Metric("returned_quantity", "sum", "l_quantity", F.col("l_returnflag") == "R"), Metric("missing", "sum", "no_such_column")]))


@query("SELECT p_brand, p_size, max(p_retailprice) AS dearest, avg(p_retailprice) AS average FROM part GROUP BY p_brand, p_size")
def pivot_max_avg(spark, d):
    return pivot(table(spark, d, "part"), PivotSpec(["p_brand", "p_size"], [Metric("dearest", "max", "p_retailprice"), Metric("average", "avg", "p_retailprice")]))


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey GROUP BY n_name""")
def pivot_null_keys(spark, d):
    near = table(spark, d, "nation").where("n_regionkey < 2")
    rows = table(spark, d, "customer").join(near, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return pivot(rows, PivotSpec(["n_name"], [Metric("customers", "count_distinct", "c_custkey")]))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS i FROM lineitem)
SELECT l_orderkey, max(CASE WHEN i = 1 THEN l_partkey END) AS l_partkey_1, max(CASE WHEN i = 1 THEN l_extendedprice END) AS l_extendedprice_1,
  max(CASE WHEN i = 2 THEN l_partkey END) AS l_partkey_2, max(CASE WHEN i = 2 THEN l_extendedprice END) AS l_extendedprice_2,
  max(CASE WHEN i = 3 THEN l_partkey END) AS l_partkey_3, max(CASE WHEN i = 3 THEN l_extendedprice END) AS l_extendedprice_3
FROM n WHERE i <= 3 GROUP BY l_orderkey""")
def pivot_wide_repeat_groups(spark, d):
    return repeat_groups(table(spark, d, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], ["l_partkey", "l_extendedprice"], 3)


@query("""
WITH latest AS (SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)
SELECT c_custkey, n_name, coalesce(orders, 0) AS orders, event_type, value
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN latest ON user_id = c_custkey""")
def view_star_search(spark, d):
    counts = table(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("orders"))
    latest = best_per_group(table(spark, d, "events"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_type", "value")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").join(latest, F.col("c_custkey") == F.col("user_id"), "left")
    return rows.select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def latest_row_per_group(spark, d):
    return best_per_group(table(spark, d, "events"), ["user_id"], [F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS priorities,
       (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer""")
def correlated_counts(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_orderpriority").alias("priorities"), F.max("o_totalprice").alias("largest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", zero("orders"), zero("priorities"), "largest")


CLEAN_OR_NONE = """
SELECT c_custkey, c_mktsegment FROM customer c
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""


@query(CLEAN_OR_NONE)
def clean_or_no_source(spark, d):
    """One pass over the orders gives both flags; a single left join replaces the two subqueries."""
    flags = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)).alias("clean"))
    return table(spark, d, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left").where("o_custkey IS NULL OR clean").select("c_custkey", "c_mktsegment")


@query("""
SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def in_or_not_in_source(spark, d):
    flags = table(spark, d, "orders").where("o_custkey IS NOT NULL").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority").startswith("1")).alias("urgent"))
    return table(spark, d, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left").where("o_custkey IS NULL OR urgent").select("c_custkey")


@query("SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') THEN 'mark' ELSE 'keep' END AS action FROM supplier")
def exists_flag_projection(spark, d):
    bad = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey").distinct()
    return table(spark, d, "supplier").join(bad, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.when(F.col("l_suppkey").isNotNull(), "mark").otherwise("keep").alias("action"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_queue(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT p_partkey AS id, p_name AS name, 'alias' AS kind FROM part UNION ALL SELECT s_suppkey, s_name, 'observation' FROM supplier")
def union_alias_observation(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("alias").alias("kind"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("observation").alias("kind"))).orderBy("name", "id")


@query("""
SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE (n_regionkey IN (1, 2) OR c_mktsegment IN ('MACHINERY')) AND c_mktsegment NOT IN ('FURNITURE') AND coalesce(n_name, 'active') NOT IN ('NATION_3')""")
def company_inclusion_filter(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    flag = F.when(F.col("n_regionkey").isin(1, 2), "Y").otherwise("N")
    return rows.where(P.included(flag, F.col("c_mktsegment"), F.col("n_name"), ["MACHINERY"], ["FURNITURE"], ["NATION_3"])).select("c_custkey", "n_name")


@query("""
SELECT p_partkey FROM part p WHERE NOT (lower(p_type) LIKE '%promo%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50))""")
def policy_exclusion(spark, d):
    part = table(spark, d, "part")
    named = part.where(F.lower("p_type").contains("promo")).select("p_partkey")
    seen = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return part.join(named.unionByName(seen).distinct(), "p_partkey", "left_anti").select("p_partkey")


@query("""
SELECT p_partkey, p_name FROM part p WHERE contains(translate(lower(coalesce(p_name, '')), ' -/', ''), 'ering') OR contains(translate(lower(p_brand), ' -/', ''), 'brand#1')
  OR EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND contains(translate(lower(s_name), ' -/', ''), '00007'))""")
def keyword_search(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    named = table(spark, d, "supplier").where(F.contains(X.compacted(F.col("s_name")), F.lit("00007"))).select("s_suppkey")
    sold = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(named, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_partkey")
    own = F.contains(X.compacted(F.col("p_name")), F.lit("ering")) | F.contains(X.compacted(F.col("p_brand")), F.lit("brand#1"))
    return P.mentioning(part, "p_partkey", own, sold).select("p_partkey", "p_name")


@query("""
SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1998 THEN strftime(o_orderdate, '%Y-%m') ELSE '' END AS shown FROM orders
WHERE strftime(o_orderdate, '%Y-%m') >= '1994-03' AND month(o_orderdate) IN (3, 7) AND NOT (trim(o_orderpriority) LIKE '%LOW')""")
def yearmonth_filter(spark, d):
    ym = F.date_format("o_orderdate", "yyyy-MM")
    rows = table(spark, d, "orders").where((ym >= "1994-03") & P.in_months(ym, months=[3, 7]) & ~F.trim("o_orderpriority").endswith("LOW"))
    return rows.select("o_orderkey", P.masked_month(ym, 1996, 1998).alias("shown"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m') >= strftime(DATE '2001-06-30' - 62, '%Y-%m') GROUP BY o_orderstatus")
def rolling_cutoff(spark, d):
    cutoff = F.date_format(F.date_sub(F.lit("2001-06-30").cast("date"), 31 * 2), "yyyy-MM")
    return table(spark, d, "orders").where(F.date_format("o_orderdate", "yyyy-MM") >= cutoff).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01') AS half_open,
       count(*) FILTER (WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-01-31 23:59:59.999999') AS end_of_day,
       count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-01-31') AS plain FROM orders""")
def date_bounds_three_ways(spark, d):
    at = F.col("o_orderdate")
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    n = lambda cond, name: F.count_if(cond).alias(name)
    low = at >= t("1995-01-01")
    return table(spark, d, "orders").agg(n(low & (at < t("1995-02-01")), "half_open"), n(low & (at <= t("1995-01-31 23:59:59.999999")), "end_of_day"), n(low & (at <= t("1995-01-31")), "plain"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, 'zzz'), c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def null_sentinel_sort_topk(spark, d):
    segment = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit("zzz"))
    return table(spark, d, "customer").orderBy(segment, F.desc_nulls_last("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_name")


@query("""
WITH m AS (SELECT max(strftime(o_orderdate, '%Y-%m')) AS latest FROM orders), w AS (
  SELECT CASE WHEN EXISTS (SELECT 1 FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('2031-05', '2031-04')) THEN '2031-05' ELSE latest END AS target FROM m)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, l_partkey AS representative FROM orders JOIN w ON strftime(o_orderdate, '%Y-%m') = target
LEFT JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate, l_linenumber) AS n FROM lineitem) ON l_orderkey = o_orderkey AND n = 1""")
def month_board(spark, d):
    """Orders of the wanted month and the one before; without any, those of the latest month, by one scalar subquery."""
    orders = table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    bounds = orders.agg(F.max("month").alias("latest"), F.coalesce(F.bool_or(F.col("month").isin("2031-05", "2031-04")), F.lit(False)).alias("there"))
    shown = orders.join(F.broadcast(bounds), F.when(F.col("there"), F.col("month").isin("2031-05", "2031-04")).otherwise(F.col("month") == F.col("latest")))
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    lines = table(spark, d, "lineitem").join(shown.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    first = best_per_group(lines, ["l_orderkey"], [rank, F.col("l_shipdate"), F.col("l_linenumber")])
    return shown.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "month", F.col("l_partkey").alias("representative"))


@query("""
SELECT kind, id FROM (SELECT 1 AS o, 'customer' AS kind, c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 2, 'supplier', s_suppkey FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 3, 'part', p_partkey FROM part WHERE p_size > 45)
ORDER BY o, id LIMIT 60""")
def review_queue_budget(spark, d):
    take = lambda name, cond, key, o, kind: table(spark, d, name).where(cond).select(F.lit(o).alias("o"), F.lit(kind).alias("kind"), F.col(key).alias("id"))
    rows = take("customer", "c_acctbal < 0", "c_custkey", 1, "customer").unionByName(take("supplier", "s_acctbal < 0", "s_suppkey", 2, "supplier")).unionByName(take("part", "p_size > 45", "p_partkey", 3, "part"))
    return rows.orderBy("o", "id").limit(60).select("kind", "id")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1")
def having_multi(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).where("parts > 1")


@query("""
WITH c AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS canonical, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, p_size, canonical, n, (SELECT max(p_partkey) FROM part p WHERE p.p_brand = c.p_brand AND p.p_type = c.p_type AND p.p_size = c.p_size AND p.p_retailprice = (SELECT max(p_retailprice) FROM part q WHERE q.p_brand = c.p_brand AND q.p_type = c.p_type AND q.p_size = c.p_size)) AS best FROM c""")
def coverage_key_dedupe(spark, d):
    best = F.max(F.struct("p_retailprice", "p_partkey"))["p_partkey"].alias("best")
    return table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("canonical"), F.count(F.lit(1)).alias("n"), best)


@query("""
WITH a AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max(value) AS value, count(*) AS observations FROM events WHERE event_id % 2 = 0 GROUP BY 1),
b AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max(value) AS value, count(*) AS observations FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, greatest(a.value, b.value) AS value, CAST(coalesce(a.observations, 0) + coalesce(b.observations, 0) AS BIGINT) AS observations FROM a FULL JOIN b ON a.user_id = b.user_id""")
def merge_upsert_observations(spark, d):
    """Two halves of the events as an old state and an arriving batch; both halves together are all rows."""
    events = table(spark, d, "events")
    side = lambda parity: events.where(F.col("event_id") % 2 == parity).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("value").alias("value"), F.count(F.lit(1)).alias("observations"))
    return merged_on_key(side(0), side(1), "user_id", ["event_type"], ["value"], "observations")


@query("""
SELECT l_orderkey, l_shipdate AS chosen, CASE l_returnflag WHEN 'R' THEN 'explicit' ELSE 'inferred' END AS basis FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def release_month_choice(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), "l_shipdate", "l_linenumber"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("b"))
    return rows.select("l_orderkey", F.col("b.l_shipdate").alias("chosen"), F.when(F.col("b.rank") == 0, "explicit").otherwise("inferred").alias("basis"))


PAIRS_SQL = """
pairs AS (SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
  AND a.o_orderpriority = b.o_orderpriority AND abs((year(a.o_orderdate) * 12 + month(a.o_orderdate)) - (year(b.o_orderdate) * 12 + month(b.o_orderdate))) <= 3)"""


def near_month_pairs(spark, d):
    """Pairs within a block of customer and priority, at most three months apart. Months bucket by four, so each row
    meets its own bucket and the next, every pair in one of them, and no block is compared as a whole."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", X.months(F.date_format("o_orderdate", "yyyy-MM")).alias("m"))
    cell = F.floor(F.col("m") / 4)
    a = orders.select(F.col("o_orderkey").alias("x"), "o_custkey", "o_orderpriority", F.col("m").alias("mx"), F.explode(F.array(cell, cell + 1)).alias("cell"), cell.alias("own_x"))
    b = orders.select(F.col("o_orderkey").alias("y"), "o_custkey", "o_orderpriority", F.col("m").alias("my"), cell.alias("cell"))
    met = a.join(b, ["o_custkey", "o_orderpriority", "cell"]).where((F.abs(F.col("mx") - F.col("my")) <= 3) & ((F.col("cell") > F.col("own_x")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))


@query("WITH " + PAIRS_SQL + " SELECT left_id, right_id FROM pairs")
def blocked_pairs_near_month(spark, d):
    return near_month_pairs(spark, d)


COMPONENTS_SQL = (
    "WITH RECURSIVE " + PAIRS_SQL + """,
e AS (SELECT left_id AS a, right_id AS b FROM pairs UNION ALL SELECT right_id, left_id FROM pairs),
r AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)"""
)


def components(spark, d):
    from quillmart.operators.components import connected_components

    return connected_components(near_month_pairs(spark, d), "left_id", "right_id")


@query(COMPONENTS_SQL + " SELECT component, count(*) AS members, max(node) AS largest FROM c GROUP BY component")
def connected_components(spark, d):
    return components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.max("node").alias("largest"))


CANONICAL_SQL = COMPONENTS_SQL + """, k AS (SELECT component, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS canonical_id FROM c JOIN orders ON node = o_orderkey GROUP BY component),
m AS (SELECT node AS duplicate_id, canonical_id FROM c JOIN k USING (component) WHERE node <> canonical_id)"""


def canonical_mapping(spark, d):
    members = components(spark, d).join(table(spark, d, "orders"), F.col("node") == F.col("o_orderkey"))
    best = members.groupBy("component").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))["k"].alias("k"))
    return members.join(best, "component").select(F.col("node").alias("duplicate_id"), (-F.col("k")).alias("canonical_id")).where("duplicate_id <> canonical_id")


@query(CANONICAL_SQL + " SELECT duplicate_id, canonical_id FROM m")
def canonical_choice(spark, d):
    return canonical_mapping(spark, d)


@query(CANONICAL_SQL + " SELECT coalesce(canonical_id, l_orderkey) AS l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN m ON l_orderkey = duplicate_id GROUP BY 1")
def merge_repoint_children(spark, d):
    moved = repointed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", canonical_mapping(spark, d))
    return moved.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("SELECT token, p_brand FROM (SELECT p_name || '#' || p_size AS token, count(DISTINCT p_brand) AS n, min(p_brand) AS p_brand FROM part GROUP BY 1) WHERE n = 1")
def brand_unique_owner(spark, d):
    from quillmart.operators.rules import unique_owner

    rows = table(spark, d, "part").select(F.concat_ws("#", "p_name", F.col("p_size").cast("string")).alias("token"), "p_brand")
    return unique_owner(rows, "token", "p_brand")


@query("""
SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_id) - 1) / 5) AS INTEGER) AS chunk FROM events""")
def queue_priority_claim(spark, d):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return chunked(table(spark, d, "events"), ["user_id"], [rank, F.col("event_id")], 5).select("user_id", "event_id", "chunk")


@query("SELECT event_type, count(DISTINCT event_id) AS n, max(value) AS largest FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-06-20' GROUP BY event_type")
def stream_dedup_counts(spark, d):
    from quillmart.streaming.ingest import ingest_events

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = ingest_events(spark, d, "events.parquet", schema, "2024-01-05", "2024-06-20", "6 hours")
    return rows.groupBy("event_type").agg(F.count_distinct("event_id").alias("n"), F.max("value").alias("largest"))


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, max(value) AS largest FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_window_counts(spark, d):
    """Counts of the days that the watermark, an hour behind the latest event, has closed."""
    from quillmart.streaming.ingest import window_counts

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = window_counts(spark, d, "events.parquet", schema)
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "largest")


@query("""
WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY o_custkey),
m AS (SELECT o_custkey, first, last, unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH)) AS m FROM s)
SELECT o_custkey, strftime(greatest(m, first), '%Y-%m-%d') AS first_day, strftime(least(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, last), '%Y-%m-%d') AS last_day FROM m""")
def month_ranges(spark, d):
    """The calendar months in which a customer may have ordered, clipped to the first and the last order."""
    span = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    rows = span.select("o_custkey", "first", "last", F.explode(F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))).alias("m"))
    return rows.select("o_custkey", F.date_format(F.greatest("m", "first"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.least(F.last_day("m"), "last"), "yyyy-MM-dd").alias("last_day"))


#: The longest common run of two names, then those on either side of it, and so on: letters in runs, twice, over all letters.
RATIO_SQL = """
sg AS (
  SELECT x, y, 0 AS alo, length(x) AS ahi, 0 AS blo, length(y) AS bhi, 0 AS m FROM lt
  UNION ALL
  SELECT x, y, CASE part WHEN 0 THEN alo ELSE i + k END, CASE part WHEN 0 THEN i ELSE ahi END, CASE part WHEN 0 THEN blo ELSE j + k END, CASE part WHEN 0 THEN j ELSE bhi END, CASE part WHEN 0 THEN k ELSE 0 END
  FROM (SELECT *, -best.k AS k, best.i AS i, best.j AS j FROM (
    SELECT x, y, alo, ahi, blo, bhi, list_min(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {'k': -list_max(list_filter(range(0, least(ahi - i, bhi - j) + 1), lambda k: x[i + 1:i + k] = y[j + 1:j + k])), 'i': i, 'j': j})))) AS best
    FROM sg WHERE alo < ahi AND blo < bhi)) f, (VALUES (0), (1)) v(part) WHERE k > 0),
ra AS (SELECT x, y, 2 * sum(m) / (length(x) + length(y)) AS ratio FROM sg GROUP BY x, y)"""


@query(f"""
WITH RECURSIVE n AS (SELECT p_brand, p_type, p_size, p_name, min(p_partkey) AS id, count(*) AS members FROM part GROUP BY ALL),
p AS MATERIALIZED (SELECT a.id AS left_id, b.id AS right_id, a.members AS left_members, b.members AS right_members, a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.id < b.id),
lt AS MATERIALIZED (SELECT DISTINCT x, y FROM p WHERE NOT contains(x, y) AND NOT contains(y, x)), {RATIO_SQL},
w AS (SELECT *, list_filter(string_split(x, ' '), lambda c: c <> '') AS s, list_filter(string_split(y, ' '), lambda c: c <> '') AS t FROM p LEFT JOIN ra USING (x, y))
SELECT left_id, right_id, left_members, right_members, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN greatest(0.82, least(length(x), length(y)) / greatest(length(x), length(y)))
  ELSE greatest(ratio, len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t)))) END AS similarity FROM w""")
def name_similarity_difflib(spark, d):
    """Different names of one block of brand, type and size, compared pairwise; ids are the smallest of a name.

    Parts of equal name are one row with their number, so a block costs the square of its names, not of its parts.
    """
    from quillmart.functions.udfs import name_similarity

    block = ["p_brand", "p_type", "p_size"]
    names = table(spark, d, "part").groupBy(*block, "p_name").agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("members"))
    side = lambda s: names.select(*block, *[F.col(c).alias(f"{s}_{c}") for c in ("p_name", "id", "members")])
    pairs = side("left").join(side("right"), block).where("left_id < right_id")
    return pairs.select("left_id", "right_id", "left_members", "right_members", name_similarity(F.col("left_p_name"), F.col("right_p_name")).alias("similarity"))
