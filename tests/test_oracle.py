"""Every registered query against its SQL on the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck, same_type
from huestrata.catalog import cpm, days, files, verbs

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_its_sql():
    for catalog in (cpm, days, files, verbs):
        assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, name):
    frame = queries()[name](spark, SF_DIR)
    result = con.execute(oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert compare(frame.toPandas(), result.df()) == ""
    assert {c for c, t in frame.dtypes if not same_type(t, types[c])} == set()


def test_entry(spark):
    assert entry(spark).count() > 0
