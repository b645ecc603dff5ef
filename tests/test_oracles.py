"""Every registered query against its oracle."""

import pytest
from conftest import DATA
from oracle import compare, duck

from sheaf.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 80


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, DATA), con, ORACLES.get(name)) is None


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "job_id" in df.columns
