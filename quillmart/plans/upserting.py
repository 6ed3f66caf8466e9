"""Observations merged into a table by natural key, as a stream and by lookup; findings adjudicated by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.functions import text as X
from quillmart.operators import lookups as L
from quillmart.plans import attribution as A
from quillmart.plans.registry import ORACLE_SQL, query
from quillmart.sources.files import table
from quillmart.streaming import upserts as U

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
KEYS = ["o_custkey", "o_orderpriority"]
#: What an order's month is based on, by its status; the month of a pending order is not known.
BASIS = {"F": "explicit_in_article", "O": "earliest_related_article_month", "P": "unknown"}
_basis_sql = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BASIS.items()) + " END"
_rank_sql = "CASE basis " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in U.PRIORITY.items()) + " ELSE 0 END"
OBSERVED_SQL = f"""
o AS (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m') END AS month, {_basis_sql} AS basis, o_orderkey FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY month IS NOT NULL DESC, {_rank_sql} DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM o)"""


def _observed(spark, d):
    rows = spark.readStream.schema(ORDERS).option("pathGlobFilter", "orders.parquet").parquet(d)
    basis = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in BASIS.items()])
    month = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM"))
    return U.upserted(spark, rows.select(*KEYS, month.alias("month"), basis.alias("basis"), F.col("o_orderkey").alias("seq")), KEYS)


@query(f"WITH {OBSERVED_SQL} SELECT o_custkey, o_orderpriority, month, basis, o_orderkey AS seq, n AS rows FROM u WHERE r = 1")
def upserted_months(spark, d):
    """The best known month of each customer and priority, out of a stream of orders."""
    return _observed(spark, d)[0]


@query(f"WITH {OBSERVED_SQL} SELECT o_custkey, o_orderpriority, 'insert' AS action, month AS month_after, basis AS basis_after, n AS rows_added FROM u WHERE r = 1")
def upsert_log(spark, d):
    """What the stream of orders changed in the table, key by key."""
    return _observed(spark, d)[1].select(*KEYS, "action", "month_after", "basis_after", "rows_added")


#: Parts of even keys are known; those of odd keys come in and are looked up in five steps.
_core = "replace(p_name, ' ', '')"
_STEPS = {
    "search_key": ["p_brand", "p_name", "p_type", "p_size"],
    "identity_key": ["p_brand", "p_name", "p_type"],
    "core_key": ["p_brand", "core"],
    "core_candidate": ["p_brand", "family"],
    "alias": ["p_name", "p_size"],
}


@query(f"""
WITH b AS (SELECT *, {_core} AS core, string_split(p_name, ' ')[-1] AS family FROM part), k AS (SELECT * FROM b WHERE p_partkey % 2 = 0), i AS (SELECT * FROM b WHERE p_partkey % 2 = 1),
{", ".join(f"{name} AS (SELECT {', '.join(keys)}, min(p_partkey) AS hit, count(DISTINCT p_brand) AS owners FROM k GROUP BY {', '.join(keys)})" for name, keys in _STEPS.items())}
SELECT i.p_partkey, coalesce({", ".join(f"{n}.hit" if n != "alias" else "CASE WHEN alias.owners = 1 THEN alias.hit END" for n in _STEPS)}) AS existing,
  CASE {" ".join(f"WHEN {n}.hit IS NOT NULL{' AND alias.owners = 1' if n == 'alias' else ''} THEN '{n}'" for n in _STEPS)} ELSE 'none' END AS step,
  CASE WHEN coalesce({", ".join(f"{n}.hit" for n in _STEPS if n != "alias")}, CASE WHEN alias.owners = 1 THEN alias.hit END) IS NULL THEN 'insert' ELSE 'update' END AS action
FROM i {" ".join(f"LEFT JOIN {n} ON " + " AND ".join(f"{n}.{c} = i.{c}" for c in keys) for n, keys in _STEPS.items())}""")
def five_step_lookup(spark, d):
    """The known part that an incoming one updates: by search key, identity key, core key, core candidate, then alias.

    The first step that finds one decides; an alias counts only where all that bear it have one owner.
    """
    rows = table(spark, d, "part").withColumns({"core": F.replace("p_name", F.lit(" "), F.lit("")), "family": F.element_at(F.split("p_name", " "), -1)})
    known, incoming = rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 1")
    tiers = []
    for name, keys in _STEPS.items():
        found = known.groupBy(*keys).agg(F.min("p_partkey").alias("existing"), F.count_distinct("p_brand").alias("owners"))
        tiers.append((name, found.where("owners = 1").drop("owners") if name == "alias" else found.drop("owners")))
    looked = L.tiered(incoming, tiers, "existing", "step")
    return looked.select("p_partkey", "existing", "step", F.when(F.col("existing").isNull(), "insert").otherwise("update").alias("action"))


# Confidence of what rules accept and of what they reject or hand on.
ACCEPTED, HELD = 80, 50
#: Layers of checks: (layer, name, test that fails, evidence); tests are SQL that both engines read.
CHECKS = [
    ("article", "too short", "letters < 40", "letters"),
    ("article", "table", "bars > 3", "bars"),
    ("name", "missing name", "anchor = ''", "anchor"),
    ("name", "short name", "anchor <> '' AND length(anchor) < 5", "anchor"),
    ("name", "number in name", "number", "anchor"),
    ("owner", "no owner", "entity IS NULL", "why"),
    ("owner", "owner unsure", "entity IS NOT NULL AND unsure", "why"),
    ("owner", "close call", "coalesce(margin, 1000) < 20", "margin"),
    ("event", "no later mention", "NOT later", "anchor"),
]
RISKY = ["number in name", "owner unsure", "close call"]
_base = r"""letters, bars, anchor, coalesce(regexp_matches(anchor, '[0-9]'), false) AS number, later, entity, needs_review AS unsure, reason AS why, margin"""
_list = ", ".join(f"CASE WHEN {test} THEN '{layer}: {name} [' || coalesce(CAST({evidence} AS VARCHAR), '') || ']' END" for layer, name, test, evidence in CHECKS)


def _in_layer(layer: str) -> str:
    return " OR ".join(f"coalesce({test}, false)" for at, _, test, _ in CHECKS if at == layer)


_risky = " OR ".join(f"coalesce({test}, false)" for _, name, test, _ in CHECKS if name in RISKY)
_DECISION = f"""CASE WHEN {_in_layer("article")} THEN 'ineligible' WHEN {_in_layer("name")} THEN CASE WHEN {_risky} THEN 'review' ELSE 'reject' END WHEN {_in_layer("owner")} OR {_in_layer("event")} THEN 'review' ELSE 'accept' END"""


@query(f"""
WITH att AS ({ORACLE_SQL["attribution"]}),
s AS (SELECT doc_id, coalesce(text, '') AS text, {A._SENTENCES} AS s FROM documents),
w AS (SELECT *, list_filter(list_transform(string_split(s[1], ' '), lambda x: {A._KEY.format("x")}), lambda x: x <> '') AS words FROM s),
b AS (SELECT doc_id, length(text) AS letters, length(text) - length(replace(text, '|', '')) AS bars, coalesce(list_sort(list_transform(words, lambda x: {{'l': -length(x), 'w': x}}))[1].w, '') AS anchor, s FROM w),
l AS (SELECT *, len(list_filter(s[2:], lambda x: anchor <> '' AND contains({A._KEY.format("x")}, anchor))) > 0 AS later FROM b),
c AS (SELECT doc_id, {_base} FROM l JOIN att USING (doc_id))
SELECT doc_id, {_DECISION} AS decision, CASE WHEN {_DECISION} = 'accept' THEN {ACCEPTED} ELSE {HELD} END AS confidence, array_to_string(list_filter([{_list}], lambda x: x IS NOT NULL), '; ') AS failed FROM c""")
def adjudication(spark, d):
    """Each document's finding under layers of checks: every check that fails is kept with its evidence.

    The first layer that fails decides: an article that does not count is ineligible; a name that fails is rejected, or
    handed on where the case is risky; an unsure owner or event is handed on; the rest is accepted.
    """
    # checks and owners come out of one reading of a document
    facts = ("letters", "bars", "anchor", "later")
    texts = A.evidence(spark, d)[1].where("doc_id IS NOT NULL")
    owners = A.attributed(None, A.scored_evidence(None, texts, A.dictionary(spark, d), facts), facts)
    rows = owners.select("doc_id", *facts, F.col("anchor").rlike("[0-9]").alias("number"), "entity", F.col("needs_review").alias("unsure"), F.col("reason").alias("why"), "margin")
    failed = F.array_compact(F.array(*[F.when(F.expr(test), F.concat(F.lit(f"{layer}: {name} ["), F.coalesce(F.expr(evidence).cast("string"), F.lit("")), F.lit("]"))) for layer, name, test, evidence in CHECKS]))
    decided = rows.withColumns({"decision": F.expr(_DECISION), "failed": F.array_join(failed, "; ")})
    return decided.select("doc_id", "decision", F.when(F.col("decision") == "accept", ACCEPTED).otherwise(HELD).alias("confidence"), "failed")
