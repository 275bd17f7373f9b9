"""Small tables with the awkward cases that every corpus operator must take."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from awkward_rows import ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
