"""Every query of the catalogue against its SQL, or for rows and schema where it has none."""

from __future__ import annotations

import pytest

from quillmart import plans

from conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same_as_sql(plans.QUERIES[name](spark, sf_dir), plans.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()


def test_entry_and_names_agree(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
