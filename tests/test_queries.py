"""Every registered query against its SQL on the smallest data set."""

import pytest

from cinderline.plans.catalog import load
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        status, detail = compare(spark, con, QUERIES[name], ORACLES[name], SF)
        assert status != "differs", detail
    else:
        assert QUERIES[name](spark, SF).count() > 0
