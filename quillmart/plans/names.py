"""Name normalisation, core keys and gates over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmart.functions import names as N
from quillmart.plans.registry import query
from quillmart.sources.files import table

# Fixed values of the demonstration rules.
RULES = N.NameRules(
    aliases=("Brand#1", "Brand#17", "Brand#2", "Acme Works"),
    stem_suffixes=("works",),
    lead_words=("new", "now", "by"),
    strip_before=("small", "red", "hot", "new"),
    strip_after=("ring", "economy", "standard", "gear"),
    fragments=("widgeteconomy", "coldvalve"),
    weak=("redring", "bluebolt"),
)
RAW = "CASE p_partkey % 4 WHEN 0 THEN 'New ' || p_brand || ' ' || p_name WHEN 1 THEN p_name || ' (' || p_type || ') - ' WHEN 2 THEN 'now, by AcmeWorks: \"' || p_name || '\"' ELSE substr(p_name, 1, CAST(p_size % 7 AS INTEGER)) || ' 2.0' END"


def _normal_sql(c: str) -> str:
    text = f"trim(regexp_replace(regexp_replace(translate({c}, '\"''`‘’“”', ''), '[·•\\[\\]{{}}()<>]', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
    text = f"regexp_replace({text}, '{N.owner_pattern(RULES)}', ' ', 'gi')"
    lead = "|".join(RULES.lead_words)
    return f"regexp_replace(regexp_replace(trim(regexp_replace({text}, ' +', ' ', 'g')), '^(?:(?:{lead})[ ,:]+){{1,3}}', '', 'i'), '^[ _/.,-]+|[ _/.,-]+$', '', 'g')"


def _core_sql(c: str) -> str:
    text = f"translate(regexp_replace(regexp_replace(lower({c}), '([0-9])\\.([0-9])', '\\1§\\2', 'g'), '[^\\p{{L}}\\p{{N}}§]+', '', 'g'), '§', '.')"
    return f"regexp_replace({text}, '{N.owner_pattern(RULES, False)}', '', 'gi')"


NAMES_SQL = f"WITH r AS (SELECT p_partkey, p_type, {RAW} AS raw FROM part), n AS (SELECT *, {_normal_sql('raw')} AS normal FROM r), k AS (SELECT *, {_core_sql('normal')} AS core FROM n)"


def raw_names(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_type", F.expr(RAW.replace("substr(p_name, 1, CAST(p_size % 7 AS INTEGER))", "substring(p_name, 1, p_size % 7)")).alias("raw"))


@query(NAMES_SQL + " SELECT p_partkey, normal, core FROM k")
def normal_names(spark, d):
    raw = F.col("raw")
    return raw_names(spark, d).select("p_partkey", N.normal_name(raw, RULES).alias("normal"), N.core_name(raw, RULES).alias("core"))


def _steps_sql() -> str:
    before = [f"CASE WHEN starts_with(c, '{p}') AND length(c) >= {len(p) + N.LEAST_CORE} THEN substr(c, {len(p) + 1}) END" for p in RULES.strip_before]
    after = [f"CASE WHEN ends_with(c, '{s}') AND length(c) >= {len(s) + N.LEAST_CORE} THEN substr(c, 1, length(c) - {len(s)}) END" for s in RULES.strip_after]
    return ", ".join(before + after)


@query(NAMES_SQL.replace("WITH r", "WITH RECURSIVE r") + f""", b AS (
  SELECT p_partkey, core AS c FROM k UNION SELECT p_partkey, s FROM (SELECT p_partkey, unnest([{_steps_sql()}]) AS s FROM b) WHERE s IS NOT NULL)
SELECT p_partkey, array_to_string(list_sort(list(c)), ',') AS candidates FROM b GROUP BY p_partkey""")
def name_candidates(spark, d):
    keys = raw_names(spark, d).select("p_partkey", N.core_name(F.col("raw"), RULES).alias("core"))
    return keys.select("p_partkey", F.array_join(F.array_sort(N.core_candidates(F.col("core"), RULES)), ",").alias("candidates"))


KEY = "regexp_replace(lower(normal), '[^\\p{L}\\p{N}]+', '', 'g')"
HELD = " OR ".join(f"contains(key, '{w}')" for w in RULES.fragments)
WEAK = ", ".join(f"'{w}'" for w in RULES.weak)


@query(NAMES_SQL + f""", g AS (SELECT *, {KEY} AS key, regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE raw END), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS src, regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS ttl FROM k),
v AS (SELECT *, CASE WHEN key = '' OR {HELD} THEN 'sentence_fragment' WHEN key IN ({WEAK}) OR (length(key) < 4 AND NOT regexp_matches(key, '[a-z0-9]')) THEN 'weak_name' WHEN length(key) < 4 THEN 'too_short'
  WHEN src <> '' AND NOT contains(src, key) AND contains(ttl, key) THEN 'title_only' ELSE '' END AS reason FROM g)
SELECT p_partkey, reason = '' AS accepted, normal AS cleaned, reason FROM v""")
def name_gate(spark, d):
    source = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("raw"))
    return raw_names(spark, d).select("p_partkey", N.name_gate(F.col("raw"), F.col("raw"), source, RULES).alias("g")).select("p_partkey", "g.*")
