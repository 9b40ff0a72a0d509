"""Every registered query at the smallest scale, against its SQL."""

import os

import pytest

from querybook import ORACLES, QUERIES
from tools.check_queries import compare, connect

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    found = [tuple(r) for r in df.collect()]
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert compare(df.columns, found, names, expected.fetchall()) == "exact"
