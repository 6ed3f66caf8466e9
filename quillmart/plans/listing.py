"""Listings by whole filter sets, long sort keys and bounded limits; audits, confidences and generated searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.plans.registry import query
from quillmart.sources.files import table

#: Filters of an order listing, as a user sets them: column, kind, value; one without a value does not filter.
FILTERS = [
    ("o_orderstatus", "not in", ["P"]), ("o_custkey", "at least", 5), ("o_custkey", "at most", 90_000), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH", "3-MEDIUM", "all"]), ("o_totalprice", "at least", 50_000.0),
    ("o_totalprice", "at most", 450_000.0), ("o_orderdate", "from", "1994-02-01"), ("o_orderdate", "before day after", "2000-11-15"), ("o_orderkey", "like", "%1%"), ("o_comment", "in", None),
]
# Fixed value: the word that leaves a list filter out.
ALL = "all"


def filter_set(df: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """All filters that have a value, as one condition on the scan; a list that holds ALL, or nothing, does not filter."""
    tests = {
        "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~F.coalesce(c, F.lit("")).isin(*v), "at least": lambda c, v: c >= v, "at most": lambda c, v: c <= v,
        "from": lambda c, v: c >= F.lit(v).cast("timestamp_ntz"), "before day after": lambda c, v: c < F.date_add(F.lit(v).cast("date"), 1).cast("timestamp_ntz"), "like": lambda c, v: c.cast("string").like(v),
    }
    for column, kind, value in filters:
        if value is None or (kind == "in" and (not value or ALL in value)):
            continue
        df = df.where(tests[kind](F.col(column), value))
    return df


def bounded(limit: int | None, most: int, otherwise: int) -> int:
    """A limit held between 1 and ``most``; the usual one where none is given."""
    return min(most, max(1, otherwise if limit is None else limit))


@query("""
SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus, '') NOT IN ('P') AND o_custkey >= 5 AND o_custkey <= 90000 AND o_totalprice >= 50000 AND o_totalprice <= 450000
  AND o_orderdate >= TIMESTAMP '1994-02-01' AND o_orderdate < TIMESTAMP '2000-11-16' AND CAST(o_orderkey AS VARCHAR) LIKE '%1%'
  AND (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))""")
def order_filter_set(spark, d):
    """Orders under a whole set of filters, with a clean line or without any: lines are one flag an order before they join."""
    orders = filter_set(table(spark, d, "orders"), [x for x in FILTERS if x[0] != "o_comment"]).select("o_orderkey")
    clean = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.coalesce(F.col("l_returnflag") == "N", F.lit(False))).alias("clean"))
    return orders.join(clean, "o_orderkey", "left").where("clean IS NULL OR clean").select("o_orderkey")


# Fixed value: the most rows of a listing.
MOST_LISTED = 50


@query(f"""
SELECT p_partkey, p_name FROM part ORDER BY CASE WHEN p_brand IS NULL THEN 1 ELSE 0 END, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 9 END, coalesce(p_size, 999), coalesce(-p_retailprice, 0), coalesce(p_name, '~'), coalesce(p_brand, '~'), p_partkey LIMIT {MOST_LISTED}""")
def seven_part_listing(spark, d, limit: int | None = 500):
    """The first parts by a key of seven parts, each with its stand-in for null; more than the most is the most."""
    kind = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(9)
    order = [F.col("p_brand").isNull().cast("int"), kind, F.coalesce("p_size", F.lit(999)), F.coalesce(-F.col("p_retailprice"), F.lit(0)), F.coalesce("p_name", F.lit("~")), F.coalesce("p_brand", F.lit("~")), F.col("p_partkey")]
    return table(spark, d, "part").orderBy(*order).limit(bounded(limit, MOST_LISTED, 20)).select("p_partkey", "p_name")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_returnflag = 'R' AND NOT EXISTS (
  SELECT 1 FROM lineitem a WHERE a.l_returnflag = 'A' AND a.l_partkey = l.l_partkey AND a.l_suppkey = l.l_suppkey AND a.l_quantity >= l.l_quantity AND a.l_shipdate > l.l_shipdate)""")
def unaudited_lines(spark, d):
    """Returned lines that no later accepted line of the part and supplier covers: an anti join on keys and ranges."""
    lines = table(spark, d, "lineitem")
    audit = lines.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("a_part"), F.col("l_suppkey").alias("a_supp"), F.col("l_quantity").alias("a_quantity"), F.col("l_shipdate").alias("a_date"))
    covers = (F.col("a_part") == F.col("l_partkey")) & (F.col("a_supp") == F.col("l_suppkey")) & (F.col("a_quantity") >= F.col("l_quantity")) & (F.col("a_date") > F.col("l_shipdate"))
    return lines.where("l_returnflag = 'R'").join(audit, covers, "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


CONFIDENCES = ["l_discount", "l_tax", "l_quantity / 50", "l_linenumber / CAST(7 AS DOUBLE)", "CASE WHEN l_returnflag = 'N' THEN CAST(1 AS DOUBLE) END", "CASE WHEN l_linestatus = 'F' THEN CAST(0.5 AS DOUBLE) END"]


@query(f"""
WITH c AS (SELECT l_orderkey, {", ".join(f"max({e}) AS c{i}" for i, e in enumerate(CONFIDENCES))} FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(({" + ".join(f"coalesce(least(1.0, greatest(0.0, c{i})), 0.0)" for i in range(6))}) / 6, 6) AS confidence, {" + ".join(f"CASE WHEN c{i} IS NULL THEN 1 ELSE 0 END" for i in range(6))} AS missing FROM c""")
def six_confidences(spark, d):
    """The mean of six confidences of an order, each held between 0 and 1; one that is missing counts as 0."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.expr(e)).alias(f"c{i}") for i, e in enumerate(CONFIDENCES)])
    held = sum((F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"c{i}"))), F.lit(0.0)) for i in range(6)), F.lit(0.0))
    return rows.select("l_orderkey", F.round(held / 6, 6).alias("confidence"), sum((F.col(f"c{i}").isNull().cast("int") for i in range(6)), F.lit(0)).alias("missing"))


# Templates of a search in order, and searches of an owner at most.
TEMPLATES, MOST_SEARCHES = ["{alias} launch", "{alias} {month}", "{alias} new {kind}"], 40


@query(f"""
WITH a AS (SELECT DISTINCT p_brand, p_name AS alias, p_type AS kind FROM part),
m AS (SELECT DISTINCT p_brand, strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-04-01'),
q AS (SELECT p_brand, 0 AS t, alias, '' AS extra, alias || ' launch' AS search FROM a UNION ALL SELECT p_brand, 1, alias, month, alias || ' ' || month FROM a JOIN m USING (p_brand) UNION ALL SELECT p_brand, 2, alias, kind, alias || ' new ' || lower(kind) FROM a),
u AS (SELECT p_brand, search, min({{'alias': alias, 't': t, 'extra': extra}}) AS spot FROM q GROUP BY ALL)
SELECT p_brand, search, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY spot, search) AS place FROM u) WHERE place <= {MOST_SEARCHES}""")
def owner_searches(spark, d):
    """Searches of each owner: its aliases by template, with months and kinds, each once in order, forty at most."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_name").alias("alias"), F.col("p_type").alias("kind"))
    names = part.drop("p_partkey").distinct()
    lines = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01' AND l_shipdate < TIMESTAMP_NTZ '1995-04-01'").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).distinct()
    months = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "month").distinct()
    values = {"{alias} launch": (names, F.lit("")), "{alias} {month}": (names.join(months, "p_brand"), F.col("month")), "{alias} new {kind}": (names, F.col("kind"))}
    out = None
    for t, template in enumerate(TEMPLATES):
        rows, extra = values[template]
        pieces: list[Column] = []
        for i, piece in enumerate(template.replace("}", "{").split("{")):
            pieces.append(F.lit(piece) if i % 2 == 0 else F.lower(piece) if piece == "kind" else F.col(piece))
        one = rows.select("p_brand", F.concat(*pieces).alias("search"), F.struct("alias", F.lit(t).alias("t"), extra.alias("extra")).alias("at"))
        out = one if out is None else out.unionByName(one)
    once = out.groupBy("p_brand", "search").agg(F.min("at").alias("at"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("at", "search")))
    return ranked.where(F.col("place") <= MOST_SEARCHES).select("p_brand", "search", "place")
