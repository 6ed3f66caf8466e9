"""Eligibility of texts by fifteen ordered rules, names resolved to owners in tiers, cost and savings reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.operators import resolve as V
from quillmart.operators import rules as R
from quillmart.plans.registry import query
from quillmart.sources.files import table

# Demonstration words of the predicates.
MEMBERS = ["apache", "mit license", "gnu general", "creative commons"]
OUTSIDERS = ["http://", "https://", "www."]
ANY = {
    "outside_goods": ["@", "card", "account"],
    "outside_services": ["api_key", "token", "password"],
    "roundup": [" and ", " und ", " et ", " y "],
    "event": ["under the", "released"],
    "market": ["license", "copyright"],
    "earnings": ["%%%", "$$$"],
    "broadcast": ["###", "***"],
    "subscription": ["subscri", "secret"],
    "campaign": ["!!", "loser"],
    "launch": ["licensed", "entire"],
    "star": ["pathetic", "trash"],
    "own_context": ["the ", "der ", "le ", "el "],
    "publication": [" | "],
    "trend": ["all rights", "terms of"],
    "general_goods": ["+1", "ssn", "iban"],
}
_count = lambda words: " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words)
#: Predicates over the lower-case text ``low`` and its first line ``title``; both engines read them.
FIRST = {name: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")" for name, words in ANY.items()} | {"members": _count(MEMBERS), "outsiders": _count(OUTSIDERS)}
SECOND = {
    "several": "members >= 2",
    "recoverable": "members < 2 AND event",
    "title_roundup": "contains(title, ' and ') AND outsiders > 0",
    "primary_outside": "outsiders > members",
    "primary_general": "general_goods AND NOT own_context",
}
# Order and confidence of the fifteen rules (accepted, confidence, reason, test).
CASCADE = [
    (False, "95", "roundup in the title", "title_roundup AND NOT recoverable"),
    (False, "90", "market article", "several AND market AND NOT recoverable"),
    (False, "90", "earnings roundup", "earnings AND roundup AND NOT recoverable"),
    (False, "95", "broadcast service", "broadcast AND outside_services"),
    (False, "95", "subscription service", "subscription AND outside_services"),
    (False, "90", "campaign only", "campaign AND NOT launch"),
    (False, "90", "star model", "star AND NOT own_context"),
    (False, "95", "publication", "publication"),
    (False, "85", "trend roundup", "trend AND roundup AND NOT recoverable"),
    (False, "95", "several members", "several AND NOT recoverable"),
    (False, "95", "mixed roundup", "members > 0 AND outsiders > 0 AND roundup"),
    (False, "95", "outside product", "primary_outside AND outside_goods AND NOT own_context"),
    (False, "90", "general product", "primary_general"),
    (False, "90", "mixed primary", "outsiders > 0 AND primary_outside AND own_context"),
    (False, "90", "outside roundup", "outside_goods AND roundup AND NOT own_context"),
    (True, "80", "eligible", "true"),
]
_chain = lambda pick: "CASE " + " ".join(f"WHEN {test} THEN {pick(ok, sure, why)}" for ok, sure, why, test in CASCADE) + " END"


@query(rf"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), l AS (SELECT *, regexp_extract(low, '([^\n]*[^\n\t\r ][^\n]*)', 1) AS title FROM t),
f AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in FIRST.items())} FROM l), s AS (SELECT *, {", ".join(f"{e} AS {c}" for c, e in SECOND.items())} FROM f)
SELECT doc_id, {_chain(lambda ok, sure, why: str(ok).lower())} AS eligible, CAST({_chain(lambda ok, sure, why: sure)} AS INTEGER) AS confidence, {_chain(lambda ok, sure, why: repr(why))} AS reason FROM s""")
def eligibility_rules(spark, d):
    """The first of fifteen rules that excludes a text, with its confidence; else the text is eligible."""
    low = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = low.withColumn("title", F.regexp_extract("low", r"([^\n]*[^\n\t\r ][^\n]*)", 1))
    for layer in (FIRST, SECOND):
        rows = rows.withColumns({c: F.expr(e) for c, e in layer.items()})
    v = rows.select("doc_id", F.expr(V.rule_table(CASCADE, "eligible")).alias("v"))
    return v.select("doc_id", F.col("v.accepted").alias("eligible"), "v.confidence", "v.reason")


# Demonstration owners with their aliases; the owner ``group`` is told apart by the kind of a part.
OWNERS = {"brand1": ["brand 1", "first brand"], "brand12": ["brand 12"], "brand2": ["brand 2", "second brand works"], "brand25": ["brand 25"], "group": ["works", "brand 20"]}
KINDS = {"PROMO": "group promo", "ECONOMY": "group economy"}
ALIASES = sorted(((a.replace(" ", ""), o) for o, names in OWNERS.items() for a in names), key=lambda x: (-len(x[0]), x[0]))
SAID = "CASE p_partkey % 5 WHEN 0 THEN replace(p_brand, '#', ' ') WHEN 1 THEN 'The ' || replace(p_brand, '#', '-') || ' Co.' WHEN 2 THEN 'second brand' WHEN 3 THEN 'B' ELSE 'Works of ' || p_name END"


def _tier_sql(pick) -> str:
    exact = " ".join(f"WHEN key = '{a}' THEN {pick(o, 'exact')}" for a, o in ALIASES)
    inside = " ".join(f"WHEN contains(key, '{a}') THEN {pick(o, 'alias in name')}" for a, o in ALIASES)
    around = " ".join(f"WHEN contains('{a}', key) THEN {pick(o, 'name in alias')}" for a, o in ALIASES)
    return f"CASE WHEN length(key) < 3 THEN {pick('', 'too short')} {exact} {inside} {around} ELSE {pick('', 'none')} END"


_kind = "CASE WHEN owner = 'group' THEN coalesce(CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END, owner) ELSE owner END"


@query(f"""
WITH k AS (SELECT p_partkey, p_type, regexp_replace(lower({SAID}), '[^a-z0-9]+', '', 'g') AS key FROM part),
o AS (SELECT *, {_tier_sql(lambda o, b: repr(o))} AS owner, {_tier_sql(lambda o, b: repr(b))} AS basis FROM k) SELECT p_partkey, {_kind} AS owner, basis FROM o""")
def owner_by_name(spark, d):
    """The owner of a written name: too short, exact, the longest alias in it, or the longest alias around it."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.regexp_replace(F.lower(F.expr(SAID)), "[^a-z0-9]+", "").alias("key"))
    found = rows.select("p_partkey", "p_type", R.owner_of(F.col("key"), ALIASES).alias("f"))
    by_kind = F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in KINDS.items()], F.col("f.owner"))
    return found.select("p_partkey", F.when(F.col("f.owner") == "group", by_kind).otherwise(F.col("f.owner")).alias("owner"), F.col("f.basis").alias("basis"))


RUNS = "SELECT CASE user_id % 3 WHEN 0 THEN 'p1' WHEN 1 THEN 'p2' ELSE 'p3' END AS provider, event_type AS model, CASE WHEN event_id % 5 < 2 THEN 'extract' ELSE 'verify' END AS task, CAST(round(value * 10) AS BIGINT) AS tokens, value, event_id % 4 = 0 AS cached, event_id % 2 = 0 AS batch, event_type = 'error' AS failed, event_id % 7 = 0 AS judged FROM events"
MEASURES = {
    "runs": "count(*)",
    "tokens": "coalesce(sum(tokens), 0)",
    "cached_runs": "count(*) FILTER (WHERE cached)",
    "batch_runs": "count(*) FILTER (WHERE batch)",
    "failed_runs": "count(*) FILTER (WHERE failed)",
    "judged_runs": "count(*) FILTER (WHERE judged)",
    "free_runs": "count(*) FILTER (WHERE tokens = 0)",
    "long_runs": "count(*) FILTER (WHERE tokens > 500)",
    "cached_tokens": "coalesce(sum(tokens) FILTER (WHERE cached), 0)",
    "batch_tokens": "coalesce(sum(tokens) FILTER (WHERE batch AND NOT cached), 0)",
    "live_tokens": "coalesce(sum(tokens) FILTER (WHERE NOT batch AND NOT cached), 0)",
    "slow_runs": "count(*) FILTER (WHERE value > 100)",
}
_measures = ", ".join(f"CAST({e} AS BIGINT) AS {c}" for c, e in MEASURES.items())
_ratios = "count(*) FILTER (WHERE cached) / CAST(count(*) AS DOUBLE) AS hit_rate, avg(value) AS latency"
REPORT = f"SELECT provider, model, task, {_measures}, {_ratios} FROM ({RUNS}) GROUP BY GROUPING SETS ((), (provider, model), (task))"


@query(REPORT)
def cost_report(spark, d):
    """Twelve counts, the cache's hit rate and the mean latency: in all, by provider and model, and by task."""
    return spark.sql(REPORT.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))


SAVINGS = """
SELECT CAST(count(*) FILTER (WHERE cached) * mean AS BIGINT) AS by_cache, CAST(count(*) FILTER (WHERE batch AND NOT cached) * mean * 0.5 AS BIGINT) AS by_batch, CAST(count(*) FILTER (WHERE failed) * mean AS BIGINT) AS by_gate,
  CAST(count(*) FILTER (WHERE judged) * mean AS BIGINT) AS by_rules, CAST(count(*) FILTER (WHERE tokens = 0) * mean AS BIGINT) AS by_dedup, CAST(count(*) FILTER (WHERE tokens > 500) * mean * 0.25 AS BIGINT) AS by_snippets
FROM (SELECT r.*, (SELECT coalesce(CAST(floor(avg(tokens)) AS BIGINT), 700) FROM runs) AS mean FROM runs r) GROUP BY mean"""


@query(f"WITH runs AS ({RUNS}) SELECT *, by_cache + by_batch + by_gate + by_rules + by_dedup + by_snippets AS saved FROM ({SAVINGS})")
def savings_report(spark, d):
    """Six estimates of tokens saved, each a count times the mean run (700 without one), and their sum."""
    runs = spark.sql(RUNS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    mean = F.coalesce(F.floor(F.avg("tokens")), F.lit(700)).cast("long")
    parts = {"by_cache": ("cached", 1.0), "by_batch": ("batch AND NOT cached", 0.5), "by_gate": ("failed", 1.0), "by_rules": ("judged", 1.0), "by_dedup": ("tokens = 0", 1.0), "by_snippets": ("tokens > 500", 0.25)}
    counted = runs.agg(mean.alias("mean"), *[F.count_if(F.expr(test)).alias(name) for name, (test, _) in parts.items()])
    estimates = counted.select(*[F.round(F.col(name) * F.col("mean") * share).cast("long").alias(name) for name, (_, share) in parts.items()])
    return estimates.withColumn("saved", sum((F.col(name) for name in parts), F.lit(0)).cast("long"))
