"""The work queue of the events: every transition, and where each target stands."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.plans.registry import query
from quillmart.streaming import jobs as J

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
COMMANDS = {"signup": "enqueue", "view": "claim", "click": "extend", "purchase": "complete", "error": "fail"}
LATENESS_MS = 3600 * 1000

_after_miss = f"CASE WHEN attempts + 1 >= {J.MOST_ATTEMPTS} THEN 'failed' ELSE 'pending' END"
#: The same transitions as an ordered fold: a row for each command, after an expiry where the claim has run out.
LOG_SQL = f"""
c AS (SELECT user_id AS target, event_id, (epoch_us(ts) // 1000) AS now, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items())} END AS command,
  row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events WHERE event_type IN ({", ".join(f"'{k}'" for k in COMMANDS)}) AND user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL),
f AS (
  SELECT DISTINCT target, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS item, 'none' AS status, 0 AS attempts, CAST(0 AS BIGINT) AS lease, CAST(NULL AS BIGINT) AS now, CAST(NULL AS BIGINT) AS event_id, '' AS command, '' AS before, '' AS verdict, false AS ran_out, '' AS ran_to, 0 AS ran_attempts, CAST(0 AS BIGINT) AS ran_at, CAST(0 AS BIGINT) AS ran_item FROM c
  UNION ALL
  SELECT target, n, CASE WHEN opens THEN item + 1 ELSE item END,
    CASE WHEN opens THEN 'pending' WHEN command = 'claim' AND held = 'pending' THEN 'running' WHEN held = 'running' AND command = 'complete' THEN 'completed' WHEN held = 'running' AND command = 'fail' THEN {_after_miss} ELSE held END,
    CASE WHEN opens THEN 0 WHEN held = 'running' AND command = 'fail' THEN attempts + 1 ELSE attempts END,
    CASE WHEN (command = 'claim' AND held = 'pending') OR (command = 'extend' AND held = 'running') THEN now + {J.LEASE_MS} ELSE lease END,
    now, event_id, command, held,
    CASE WHEN command = 'enqueue' THEN CASE WHEN opens THEN 'accepted' ELSE 'duplicate' END WHEN command = 'claim' AND held = 'pending' THEN 'accepted' WHEN held = 'running' AND command IN ('extend', 'complete') THEN 'accepted'
      WHEN held = 'running' AND command = 'fail' THEN CASE WHEN attempts + 1 >= {J.MOST_ATTEMPTS} THEN 'failed' ELSE 'retry' END ELSE 'rejected' END,
    ran_out, held, attempts, lease, item
  FROM (SELECT *, command = 'enqueue' AND held NOT IN ('pending', 'running') AS opens FROM (
    SELECT c.target, c.n, c.event_id, c.command, c.now, f.item, f.lease, f.status = 'running' AND f.lease < c.now AS ran_out,
      CASE WHEN f.status = 'running' AND f.lease < c.now THEN CASE WHEN f.attempts + 1 >= {J.MOST_ATTEMPTS} THEN 'failed' ELSE 'pending' END ELSE f.status END AS held,
      CASE WHEN f.status = 'running' AND f.lease < c.now THEN f.attempts + 1 ELSE f.attempts END AS attempts FROM f JOIN c ON c.target = f.target AND c.n = f.n + 1))),
last AS (SELECT * FROM f QUALIFY n = max(n) OVER (PARTITION BY target)),
log AS (
  SELECT target, item, now AS at_ms, event_id, command, before, status AS after, verdict, attempts FROM f WHERE n > 0
  UNION ALL SELECT target, ran_item, ran_at, -1, 'expire', 'running', ran_to, CASE WHEN ran_to = 'failed' THEN 'failed' ELSE 'retry' END, ran_attempts FROM f WHERE ran_out
  UNION ALL SELECT target, item, lease, -1, 'expire', 'running', {_after_miss}, CASE WHEN attempts + 1 >= {J.MOST_ATTEMPTS} THEN 'failed' ELSE 'retry' END, attempts + 1 FROM last
    WHERE status = 'running' AND lease < (SELECT max(now) FROM c) - {LATENESS_MS})"""


@query(f"WITH RECURSIVE {LOG_SQL} SELECT target, item, at_ms, event_id, command, before, after, verdict, attempts FROM log")
def queue_transitions(spark, d):
    """Every command on the queue with its verdict, and every claim that ran out, as a stream leaves them."""
    return J.queue_log(spark, J.commands_of(spark, d, "events.parquet", SCHEMA, COMMANDS))


@query(f"""
WITH RECURSIVE {LOG_SQL}
SELECT target, max(item) AS items, arg_max(after, (at_ms, event_id)) AS status, count(*) FILTER (verdict = 'duplicate') AS duplicates, count(*) FILTER (verdict = 'rejected') AS rejected,
  count(*) FILTER (verdict = 'retry') AS retries, count(*) FILTER (after = 'failed' AND before <> 'failed') AS failed, count(*) FILTER (after = 'completed' AND before <> 'completed') AS completed FROM log GROUP BY target""")
def queue_states(spark, d):
    """Where each target stands, and what became of its commands, out of the log."""
    log = queue_transitions(spark, d)
    became = lambda status: F.count_if((F.col("after") == status) & (F.col("before") != status)).alias(status)
    counts = [F.count_if(F.col("verdict") == v).alias(name) for v, name in (("duplicate", "duplicates"), ("rejected", "rejected"), ("retry", "retries"))]
    return log.groupBy("target").agg(F.max("item").alias("items"), F.max_by("after", F.struct("at_ms", "event_id")).alias("status"), *counts, became("failed"), became("completed"))
