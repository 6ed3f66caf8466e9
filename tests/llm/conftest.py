"""Tables of the operator tests."""

from __future__ import annotations

import pytest
from llm_rows import EDGE, documents


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="session")
def no_documents(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def medium_dir(sf_dir):
    """Enough labelled rows for held-out accuracy."""
    return sf_dir.replace("sf0.001", "sf0.01")
