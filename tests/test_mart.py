"""The star of order lines: its tasks follow the lines, and orders with lines meet once."""

from __future__ import annotations

import re

from quillmart.plans import mart


def test_tasks_of_the_star_follow_its_lines(spark, sf_dir, monkeypatch):
    """A task gets LINES_A_TASK lines, in which it also counts its orders; the lines move for that once."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        for tasks in (9, 40):
            monkeypatch.setattr(mart, "LINES_A_TASK", -(-lines // tasks))
            rows = mart.pivot_product_primary(spark, sf_dir)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            dealt = re.findall(r"Exchange hashpartitioning\(([a-z]_orderkey)#\d+L?, (\d+)\)", plan)
            assert sorted(dealt) == [("l_orderkey", str(tasks)), ("o_orderkey", str(tasks))]
            # no exchange by the groups and the order, beside that by the groups alone
            assert not re.search(r"hashpartitioning\([^)]*p_brand[^)]*l_orderkey", plan)
            assert sum(r["orders"] for r in rows.collect()) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
