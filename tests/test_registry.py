"""Every registered query against its SQL on the given tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_point  # noqa: E402
from registry.queries import ORACLES, QUERIES  # noqa: E402
from check_queries import connect, difference  # noqa: E402
from conftest import SF_DIR  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    rows = [tuple(row) for row in frame.collect()]
    assert rows
    assert difference(frame, rows, duck.execute(ORACLES[name])) is None


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["merchant_city", "is_fraud", "nb_transactions"]
    assert result.count() > 0
