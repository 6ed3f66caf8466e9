"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(REPO), os.environ.get("PYTHONPATH")) if x)
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL


def plain(value):
    """A value that compares equal between the two engines."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def same_as_sql(df: DataFrame, sql: str, folder: str) -> int:
    """Assert that the query has the columns and rows of the SQL on the same tables; gives the number of rows."""
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    found = db.execute(sql)
    names, expected = [x[0] for x in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = df.collect()
    assert len(got) == len(expected)
    for x, y in zip(rows_of(df.columns, got), rows_of(names, expected), strict=True):
        assert x == y
    return len(got)
