"""Every registered query beside its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.oracle import QUERIES
from checks.queries import REGISTRY

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, tables, name):
    assert compare(spark, tables, FOLDER, name) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
