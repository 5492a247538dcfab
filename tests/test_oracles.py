"""Each registered query next to its DuckDB twin, at the smallest scale."""

import pytest
from compare import differences, duck

from tideglass.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return duck(sf)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    rows = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert differences(rows, db.sql(ORACLES[name]).df()) == ""


def test_flagship_has_rows(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
